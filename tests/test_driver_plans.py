from pyspark.sql import functions as F

from kinweave.operators import cluster, households
from kinweave.plans import catalogue, findings

SF = "/root/testdata/sf0.001"


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def most_joins(spark, monkeypatch, name):
    """Of the plans that a query hands to the driver."""
    seen = []

    def noted(df, hold=cluster.held):
        seen.append(joins(df))
        return hold(df)

    for module in (cluster, findings):
        monkeypatch.setattr(module, "held", noted)
    return max([joins(catalogue.QUERIES[name](spark, SF)), *seen])


def test_priority_rank_in_small_plans(spark, monkeypatch):
    """Views stand on held ones, and each finding is a query of its own."""
    assert most_joins(spark, monkeypatch, "priority_rank") <= 10


def test_review_summary_in_small_plans(spark, monkeypatch):
    assert most_joins(spark, monkeypatch, "review_summary") <= 10


def test_review_summary_sends_only_small_tables(spark, monkeypatch):
    """The driver makes what is sent; the session's setting stays as it was."""
    limit = lambda: spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    seen, was = [], limit()
    for module in (cluster, findings):
        monkeypatch.setattr(module, "held", lambda df, hold=cluster.held: seen.append(limit()) or hold(df))
    catalogue.QUERIES["review_summary"](spark, SF)
    assert len(seen) > 12 and max(seen) <= 1 << 18 < was and limit() == was


def test_relationship_resolution_in_small_plans(spark, monkeypatch):
    assert most_joins(spark, monkeypatch, "relationship_resolution") <= 14


def test_unlike_names_are_not_sent(spark, monkeypatch):
    """The driver gets the pairs of names over the threshold only, and scores are those of all pairs."""
    sent, one = [], "id_1 long, id_2 long, role_1 string, role_2 string, name_1 string, name_2 string, age_1 int, age_2 int, sex_1 string, sex_2 string, source_1 int, source_2 int"
    monkeypatch.setattr(cluster, "sent", lambda df, most, f=cluster.sent: sent.append(df.count()) or f(df, most))
    names = [("ann kelly", "ann kelly", 0.5), ("ann kelly", "anne kelly", 0.5), ("ann kelly", "bob ward", 0.2), (None, "bob ward", 0.2)]
    df = spark.createDataFrame([(i, i, "head", "son", a, b, 1, 40, "M", "M", 3, 4) for i, (a, b, _) in enumerate(names)], one)
    got = {r.id_1: r.score for r in households.match_score(df).collect()}
    assert got == {i: s for i, (*_, s) in enumerate(names)} and sent == [2]


def test_links_without_a_row_stay(spark):
    """Also those of a person that a match touches."""
    rows = [(i, i // 100, "bob ward", "head", 30 + 10 * (i // 100), "M", 2 + i // 100) for i in (101, 201)]
    ppl = spark.createDataFrame(rows, "recorded_person_id long, record_id long, name_as_recorded string, role string, age int, sex_as_recorded string, source_id int")
    links = spark.createDataFrame([(7, 101, 0.5), (7, 901, 0.5), (8, 902, 0.5)], "person_id long, recorded_person_id long, score double")
    pairs = spark.createDataFrame([(1, 2, 0.9)], "record_id_1 long, record_id_2 long, score double")
    got = {(r.person_id, r.recorded_person_id) for r in households.resolve_relationships(pairs, ppl, links).collect()}
    assert got == {(7, 101), (7, 201), (7, 901), (8, 902)}


def test_held_leaves_no_shuffle(spark):
    """What was shuffled for a held table goes with the query that wrote it; the session's setting stays as it was."""
    left = lambda: spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, was = left(), spark.conf.get(cluster.CLEANUP, None)
    assert cluster.held(df).count() == 7
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    assert left() <= before + 1 and spark.conf.get(cluster.CLEANUP, None) == was  # the count shuffles once
