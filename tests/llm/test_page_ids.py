"""Archives of pages with ids of other types, null ids, and long payloads."""

from kinweave.llm import warc


def test_ids_keep_their_type(spark):
    big = "x" * 200
    df = spark.createDataFrame([("b", "http://h/1", big), ("a", "http://h/2", big), ("a b: c", "http://h/3", "y"), (None, "http://h/4", "z" * 150)], "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.captures(df).collect()}
    assert got == {"a": ("response", None), "b": ("revisit", "a"), "a b: c": ("response", None), None: ("response", None)}


def test_long_payloads_make_small_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"{i}" * 50_000) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    warc.write(df, f"file://{tmp_path}/a", file_bytes=200_000)
    assert len(list((tmp_path / "a").glob("part-*.gz"))) >= 4 and warc.read(spark, f"file://{tmp_path}/a").count() == 36
