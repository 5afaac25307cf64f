import numpy as np
import pytest

from kinweave.operators import cluster
from kinweave.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_person_pairs_are_joined_once(spark, monkeypatch):
    """The pairs come from one join of held rows, and no later query makes them again or joins with them."""
    plans = []

    def noted(df, hold=cluster.held):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return hold(df)

    for module in (cluster, catalogue.persons):
        monkeypatch.setattr(module, "held", noted, raising=False)
    last = catalogue.QUERIES["person_resolution"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    made = [p for p in [*plans, last] if "birth_year" in p and "MapInArrow" in p]
    assert len(made) == 1 and made[0].count("Join ") == 1 and "birth_year" not in last


@pytest.mark.parametrize("most", [1, 8, 1 << 20])
def test_star_weights(spark, most):
    """The best weight of each node, however its edges fall into batches."""
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 200), rng.integers(0, 60, 200), rng.random(200), strict=True)]
    want = {}
    for a, b, w in rows:
        for x in (a, b):
            want[x] = max(want.get(x, w), w)
    got = {}
    for r in cluster.star_edges(spark.createDataFrame(rows, "u long, v long, score double").repartition(3), most, "score").collect():
        got[r.u] = max(got.get(r.u, r.w), r.w)
    assert got == want
