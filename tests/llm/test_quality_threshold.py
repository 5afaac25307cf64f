import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import forest


@pytest.mark.parametrize("bad", [0, 40])
def test_threshold_of_counts(bad):
    """That of all the scores, one by one."""
    rng = np.random.default_rng(6)
    scores = np.concatenate([rng.normal(40000, 3000, 3000), rng.normal(52000, 5000, bad)]).astype(int)
    good = np.arange(len(scores)) < 3000
    steps = np.unique(scores)
    count = lambda of: np.array([(scores[of] == s).sum() for s in steps])
    got = forest.threshold_of_counts(steps, count(good), count(~good), 0.005)
    assert got == pytest.approx(forest.threshold(scores / forest.STEPS, good, 0.005), abs=1e-9)


def test_every_labelled_row_counts(spark):
    """45 000 labelled rows: the cut is that of all of them, where it used to be that of about 20 000."""
    n = 45_000
    docs = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), (60 + F.col("doc_id") % 37).cast("int")), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", i), F.lit(4000)))), " "))
    labels = docs.select("doc_id", (F.col("doc_id") % 50 != 0).cast("int").alias("quality"))
    judge = forest.QualityJudge(docs, labels, trees=10)
    rows = docs.orderBy("doc_id").toPandas()
    got = judge.verdicts(rows["text"].tolist())
    fine = ~got["base_failed"].to_numpy()
    want = forest.threshold(got["anomaly"].to_numpy()[fine], (rows["doc_id"] % 50 != 0).to_numpy()[fine], 0.005)
    assert fine.sum() > 40_000 and judge.cut == pytest.approx(want, abs=1e-9)
