import pytest
from pyspark.sql import functions as F

from kinweave.plans import audit
from kinweave.sources import ingest
from kinweave.streaming import incremental

EARLY = {"firstname": "", "surname": "", "age": "", "sex": "", "relation_to_head_updated": "", "occupation_updated": "", "townland_clean": "", "birthplace": "", "images": "", "image_group": ""}


def extract(path, rows, source=3, drop=()):
    cols = [c for c in ingest.HEADERS[source] if c not in drop]
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    path.write_text("﻿" + "\n".join([",".join(cols)] + [",".join(quote(r.get(c, "")) for c in cols) for r in rows]) + "\n", encoding="utf-8")
    return str(path)


def home(group, first, last, age, sex, role, place="", image=""):
    return {"image_group": group, "firstname": first, "surname": last, "age": age, "sex": sex, "relation_to_head_updated": role, "townland_clean": place, "images": image}


def test_census(spark, tmp_path):
    image = "[{'form': 'Form A', 'id': 'doc1'}]"
    rows = [home("h1", "Patrick", "O'Brien", "40", "M", "Head of Family", "drummenny upper", image), home("h2", "", "", "x", "", "Lodger"), home("h1", "Mary", "O'Brien", "38", "F", "Wife", "drummenny upper", image), home("h1", "Pat", "O'Brien\nJr", "12", "M", "Son", "drummenny upper", image)]
    path = extract(tmp_path / "a_1901.csv", rows)
    record, person = ingest.ingest_census(ingest.read_census(spark, path, 3), 3)
    r = record.orderBy("record_id").collect()
    assert [x.record_id for x in r] == [1, 2] and '"doc1"' in r[0].record_parameters and '"household-h2"' in r[1].record_parameters
    assert r[0].date == "1901-03-31" and r[0].place_as_recorded == "drummenny upper" and r[1].place_as_recorded is None and r[1].notes
    assert r[0].raw_text.count("Brien") == 3
    p = person.orderBy("recorded_person_id").collect()
    assert [x.record_id for x in p] == [1, 2, 1, 1] and [x.role for x in p] == ["head", "boarder", "spouse", "son"]
    assert p[1].name_as_recorded == "[unknown]" and p[1].age is None and "age not a number" in p[1].notes and p[0].notes is None


def test_header_and_bulk(spark, tmp_path):
    good, bad, other = extract(tmp_path / "x_1911.csv", [home("h1", "Ann", "Boyle", "3", "F", "Daughter")], 4), extract(tmp_path / "y_1901.csv", [], 3, drop=("age",)), str(tmp_path / "z.csv")
    record, person, errors = ingest.bulk_ingest(spark, [good, bad, other])
    assert record.count() == person.count() == 1 and set(errors) == {bad, other}
    with pytest.raises(ingest.HeaderError):
        ingest.read_census(spark, bad, 3)


def test_places(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("place_id,logainm_id,name_en,place_type\n1,10,Drumenny,Townland\n2,,Donegal,County\n")
    places = ingest.read_places(spark, str(path))
    assert [r.place_type for r in places.orderBy("place_id").collect()] == ["townland", "county"]
    assert ingest.new_places(places, places).count() == 0 and ingest.new_places(places, places.filter("place_id = 1")).count() == 1
    path.write_text("place_id,logainm_id,name_en,place_type\n1,10,,Townland\n")
    with pytest.raises(ValueError):
        ingest.read_places(spark, str(path))


def test_stream_and_audit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,v\n1,a\n2,b\n")
    schema = spark.createDataFrame([], "k int, v string").schema
    for _ in range(2):  # a second run finds nothing new
        incremental.ingest_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    old, new = spark.createDataFrame([(1, "x", None)], "person_id long, label string, gender string"), spark.createDataFrame([(1, "y", None)], "person_id long, label string, gender string")
    assert [(r.field_name, r.old_value, r.new_value) for r in audit.updated(old, new, "person", "person_id").collect()] == [("label", "x", "y")]
    audit.append(audit.created(old, "person", "person_id", group="g"), str(tmp_path / "log"))
    audit.append(audit.noted(old, "verify", "person", "person_id", group="g"), str(tmp_path / "log"))
    log = spark.read.schema(audit.LOG).parquet(str(tmp_path / "log"))
    assert audit.history(log, group="g").count() == 2 and audit.history(log, entity_id=7).count() == 0
    with audit.Timer(spark, "similarity", "block", str(tmp_path / "runs")) as t:
        pass
    assert t.seconds >= 0 and spark.read.parquet(str(tmp_path / "runs")).filter(F.col("ok")).count() == 1


def test_rest(spark):
    from kinweave.sources import rest

    data = [{"Census_Year": 1901 + 10 * (i % 2), "TOWNLAND": f" Upper  {i}", "ded": None} for i in range(25)]
    failed, waited = [], []

    def fetch(limit, offset):
        if offset == 10 and len(failed) < 2:
            failed.append(1)
            raise OSError("again")
        return data[offset : offset + limit]

    got = rest.census(spark, fetch, 1901, ["census_year", "townland", "ded"], size=10, sleep=waited.append)
    assert got.count() == 13 and got.filter("townland_clean = 'upper 2'").count() == 1 and waited[1:3] == [1.0, 2.0]
    child = [{"ID": 2, "nameEN": "Drum", "category": "Townland", "latitude": "54.5"}]
    found = rest.places(spark, {"id": 1, "name_en": "Parish", "place_type": "civil parish"}, lambda n, o: child[o : o + n])
    assert {(r.logainm_id, r.place_type, r.parent_id) for r in found.collect()} == {(1, "civil_parish", None), (2, "townland", 1)}
