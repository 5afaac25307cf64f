import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.operators import cluster, linkage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_not_shuffled_to_scores(spark, monkeypatch):
    """Few pairs of values go to the pairs of rows; many are joined by key, with equal results."""
    names = ["ann kelly", "anne kelly", None, "bob ward", "ann ward"]
    pairs = spark.createDataFrame([(i, names[i % 5], names[i // 5 % 5]) for i in range(50)], "id long, a string, b string")
    near = X.with_similarity(pairs, "a", "b", "jw")
    assert "BroadcastHashJoin" in plan(near) and "SortMergeJoin" not in plan(near)
    monkeypatch.setattr(X, "SENT_ROWS", 0)
    want = {(r.id, r.jw) for r in near.collect()}
    assert want == {(r.id, r.jw) for r in X.with_similarity(pairs, "a", "b", "jw").collect()} and len(want) == 50


def test_term_frequencies_go_to_the_pairs(spark, monkeypatch):
    tf = spark.createDataFrame([("ann kelly", 0.5)], "value string, tf double")
    pairs = spark.createDataFrame([("ann kelly", "ann kelly", 3)], "l_name_norm string, r_name_norm string, gamma_name_norm int")
    s = linkage.LinkageSettings((), (linkage.PERSON.comparisons[0],), floor=0.0)
    assert "SortMergeJoin" not in plan(linkage.score(pairs, s, terms={"name_norm": tf}))


@pytest.mark.parametrize("most", [1, 8, 1 << 20])
def test_star_edges(spark, most):
    """One edge per node and task, with the components of all edges."""
    rng = np.random.default_rng(4)
    u, v = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    clique = [(1000 + i, 1000 + j) for i in range(60) for j in range(i)]
    rows = [(int(a), int(b)) for a, b in zip(u, v, strict=True)] + clique + [(5000, 5000)]
    df = spark.createDataFrame(rows, "u long, v long").repartition(3)
    nodes, roots = cluster.contract(*np.array(rows).T)
    want = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    got = [(r.u, r.v) for r in cluster.star_edges(df, most).collect()]
    again = cluster.contract(*np.array(got).T)
    assert dict(zip(*(x.tolist() for x in again), strict=True)) == want
    assert most < 1 << 20 or len(got) <= 3 * len(nodes) < len(rows)
    assert dict(map(tuple, cluster.connected_components(df, "u", "v").collect())) == want
    assert want[1042] == 1000 and want[5000] == 5000
    assert cluster.star_edges(df.limit(1).union(spark.createDataFrame([(1, None)], "u long, v long"))).filter(F.col("v").isNull()).count() == 1
