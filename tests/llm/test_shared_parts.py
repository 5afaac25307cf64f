"""What the operators share, and columns of any name."""

import pytest
from pyspark.sql import functions as F

from kinweave.llm import common, exact, forest, mixing, simhash

CLASH = ("_id", "_h", "_hash", "_again", "_g", "row", "h", "key", "_p", "_th", "_b", "_w", "_in", "_pass", "_row", "_quality", "sha", "n_points", "asked", "plain.dot")


def test_bloom_filter(spark, monkeypatch):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    rows = spark.range(0, 30_000)
    for most in (1 << 27, 1 << 13):  # the second is full: it still holds for every key
        monkeypatch.setattr(common, "BLOOM_MOST", most)
        hit = {r.id for r in rows.filter(common.may_be_in(keys, "k")(F.col("id"))).collect()}
        assert set(range(0, 3000, 3)) <= hit and (most < 1 << 27 or len(hit) < 3000)
    assert rows.filter(common.may_be_in(keys.limit(0), "k")(F.col("id"))).count() == 0


def test_no_machine_local_folder(spark, monkeypatch):
    """A cluster's session has to name the shared folder."""

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(type("Session", (), {"conf": Conf, "sparkContext": Context}))


def test_clashing_columns_stay(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "a"), (2, text, "a"), (None, text + " x", "b"), (3, " ".join(f"v{i}" for i in range(70)), None)], "doc_id long, text string, source string")
    docs = docs.withColumns({c: F.lit(f"mine {c}") for c in CLASH})
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, got in (("exact", exact.drop_copies(docs)), ("near", simhash.drop_near_copies(docs)), ("mix", mixing.mix(docs, block_tokens=16)), ("good", forest.keep_good(docs, labels))):
        rows = got.collect()
        assert got.columns == docs.columns and rows, name
        assert all(r[c] == f"mine {c}" for r in rows for c in CLASH), name
