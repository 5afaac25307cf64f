"""The url filter on hosts that its table does not hold."""

from pyspark.sql import functions as F

from kinweave.llm import urls


def test_unseen_urls():
    """Made-up urls of another seed: cues the table knows in new company, and ordinary hosts."""
    model, seen = urls.UrlModel(), {u.partition("/")[0] for u, _ in urls.labelled_urls()}
    new = [(model.score(*((u.partition("/")[0], "/" + u.partition("/")[2]))), y) for u, y in urls.labelled_urls(seed=99) if u.partition("/")[0] not in seen]
    assert sum(y for _, y in new) > 200
    assert sum(s >= 0.5 for s, y in new if y) > 0.65 * sum(y for _, y in new)
    assert sum(s >= 0.5 for s, y in new if not y) < 0.02 * sum(not y for _, y in new)


def test_well_known_and_plain_sites_pass():
    model = urls.UrlModel()
    hosts = "github.com en.wikipedia.org arxiv.org stackoverflow.com docs.python.org developer.mozilla.org www.irishtimes.com kubernetes.io pytorch.org www.gov.ie".split()
    assert [h for h in hosts if model.score(h, "/en/1") >= 0.5] == []


def test_rules_spare_the_method(spark):
    """Where a rule decides, no score is computed; a null url and one without a scheme get the method's verdict."""
    df = spark.createDataFrame([(1, "http://a.net/es/x"), (2, None), (None, "plain"), (3, "http://a.org/" + "x" * 100_000)], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df.withColumn("open_", F.lit(1))).collect()}
    assert got[1].url_score is None and got[1].verdict == "block" and got[2].url_score == 0 and got[None].verdict == "allow" and got[3].url_score is not None
