import corpus_pipeline
from kinweave.llm import common

SF = "/root/testdata/sf0.001"


def nodes(plan):
    """(Python nodes that run in one task with the root of a physical plan, the most in any task, names of all nodes)."""
    below = [nodes(plan.children().apply(i)) for i in range(plan.children().size())]
    name = plan.nodeName()
    # the sides of a union are tasks of their own, those of a join are not
    here = (max if name == "Union" else sum)([b[0] for b in below] or [0]) + any(x in name for x in ("Python", "Pandas", "Arrow"))
    most = max([here, *[b[1] for b in below]])
    return 0 if "Exchange" in name else here, most, [name, *[n for b in below for n in b[2]]]


def test_a_task_takes_one_python_worker(spark, monkeypatch):
    """Executors keep the workers of all stages, each with what any of them loads; small tables take none."""
    seen = []

    def noted(self, df, name, *how, save=common.Scratch.save):
        seen.append(nodes(df._jdf.queryExecution().executedPlan())[1:])
        return save(self, df, name, *how)

    monkeypatch.setattr(common.Scratch, "save", noted)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        corpus_pipeline.run(spark, SF)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert max(most for most, _ in seen) == 1
    assert not any("ExistingRDD" in n for _, names in seen for n in names)
