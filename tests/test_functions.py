import math

import pytest
from pyspark.sql import functions as F

from kinweave.functions import names as N
from kinweave.functions import text as X
from kinweave.operators import constraints


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    "f, cases",
    [
        (X.soundex, {"O'Brien": "B650", "Brien": "B650", "Owens": "W520", "McNamara": "M256", "MacNamara": "N560", "Mack": "K000", "Pfister": "P123", "Tymczak": "T520", "Kelly": "K400", "Gallagher": "G426", "Gallaher": "G460", None: None, "": None}),
        (X.map_role, {"Head of Family": "head", "Wife": "spouse", "Nice": "niece_nephew", "Mother In Law": "in_law", "Great Grandson": "grandchild", "Shop Keeper": "servant", "Pupil": "unknown", " ": None, None: None, "Son's Wife": "in_law"}),
        (X.parse_age, {"12": 12, "12.7": 12, " ": None, "x": None, "nan": None, "inf": None, None: None, " 7 ": 7}),
        (X.normalise_place, {"Drummenny Upper": "drumeny uper", "Tullyleague or Tullybrook": "tulyleague", "Co. Donegal": "donegal"}),
        (N.canonical_forename, {"pat": "patrick", "john": "johnny", "anne": "alicia", "mary": "marie", "james": "james", "frank": "ffrancis", "owen": "owen", "mary anne": "mary anne", "willie": "william", "kay": "kathleen"}),
        (N.forename_class, {"patrick": "exact", "paddy": "exact", "patty": "approved", "owen": "suspicious", None: "suspicious"}),
        (N.infer_gender, {"Patrick X": "M", "Mary X": "F", "Pat X": None, "Jean X": "F", "Terry X": "M", None: None}),
        (X.surname_of, {"Mary Ann Kelly": "kelly", "Kelly": "kelly", "": None, None: None}),
        (X.forename_of, {"Mary Ann Kelly": "mary ann", "Kelly": "kelly", "": None}),
        (X.year_of, {"1901-03-31": 1901, "1911": 1911, "about 1911": None, None: None}),
    ],
)
def test_columns(spark, f, cases):
    assert values(spark, [(k,) for k in cases], f(F.col("x"))) == list(cases.values())


def test_jaro_winkler():
    assert math.isclose(X.jaro_winkler_of("martha", "marhta"), 0.961111, abs_tol=1e-6)
    assert math.isclose(X.jaro_winkler_of("ab", "xb"), 0.666667, abs_tol=1e-6)
    assert math.isclose(X.jaro_winkler_of("patrick", "patk"), 0.808333, abs_tol=1e-6)
    assert X.jaro_winkler_of("", "") == 0.0 and X.jaro_winkler_of(None, "a") is None


def test_overlap(spark):
    rows = [(["a", "b"], ["b", "c"]), (["a"], ["a", "b", "c"]), ([], ["a"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.overlap(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, None, None]


@pytest.mark.parametrize("a1, s1, a2, s2, ok", [(40, 3, 50, 4, True), (40, 3, 54, 4, False), (40, 3, 61, 5, True), (50, 3, 45, 4, False), (0, 3, 30, 4, True), (None, 3, 30, 4, True), (50, 4, 40, 3, True)])
def test_age(spark, a1, s1, a2, s2, ok):
    df = spark.createDataFrame([(a1, s1, a2, s2)], "a1 int, s1 int, a2 int, s2 int")
    assert df.select(constraints.age_valid(F.col("a1"), F.col("s1"), F.col("a2"), F.col("s2"))).first()[0] is ok


@pytest.mark.parametrize("a, b, ok", [("Pat Kelly", "Patrick Kelly", True), ("Pat Kelly", "Patrick Walsh", False), ("John Kelly", "John Walsh", True), ("Owen Kelly", "John Kelly", False)])
def test_name_gate(spark, a, b, ok):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(constraints.names_match(F.col("a"), F.col("b"))).first()[0] is ok


def test_name_tables():
    assert len(N.variants()) == 53 and len(N.canonical()) == 89
    assert len(set(N.MALE)) == 94 and len(set(N.FEMALE)) == 93
