import brute
from pyspark.sql import functions as F
from test_shared_parts import CLASH

import corpus_pipeline


def test_stage_keeps_one_row_of_each_simhash_component(spark):
    """Null and repeated ids take no other row with them, columns of any name stay, and texts without words link like others."""
    text = [" ".join(f"{c}{i}" for i in range(200)) for c in "abcd"]
    rows = [(5, text[0]), (3, text[0].upper()), (None, text[0] + " "), (7, text[1]), (7, text[2]), (None, text[3]), (None, text[3]), (9, None), (8, ""), (6, text[1].replace("b100", "x").replace("b50 ", "y "))]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, doc_id long, text string").withColumns({c: F.lit(f"mine {c}") for c in CLASH})
    got = corpus_pipeline.simhash_dedup(spark, docs, "")
    prints = [(k, brute.simhash(t)) for k, (_, t) in enumerate(rows)]
    comps = brute.linked(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    first = lambda root: min((rows[k][0] is None, rows[k][0] or 0, k) for k in comps if comps[k] == root)
    want = {(c, first(c)[:2]) for c in set(comps.values())}
    kept = got.collect()
    assert len(kept) == len(want) and {(comps[r.k], (r.doc_id is None, r.doc_id or 0)) for r in kept} == want
    assert got.columns == docs.columns and all(r[c] == f"mine {c}" for r in kept for c in CLASH)
    assert corpus_pipeline.simhash_dedup(spark, docs.limit(0), "").count() == 0
