"""Checks of linked persons: gender, age progression, names, coherence of households."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import AGE_TOLERANCE, AGE_TOLERANCE_DEFAULT, CENSUS_YEAR
from ..functions import names as N


def census_year(source: Column) -> Column:
    out = F.lit(None).cast("int")
    for s, y in CENSUS_YEAR.items():
        out = F.when(source == s, F.lit(y)).otherwise(out)
    return out


def gender_consistent(name_1: Column, name_2: Column) -> Column:
    """False only if both names have a gender and they differ."""
    a, b = N.infer_gender(name_1), N.infer_gender(name_2)
    return F.coalesce(a == b, F.lit(True))


def age_valid(age_1: Column, source_1: Column, age_2: Column, source_2: Column) -> Column:
    """Ages may differ from the years between the censuses by the pair's tolerance, and never fall.

    Missing ages, age 0 and unknown sources pass."""
    y1, y2 = census_year(source_1), census_year(source_2)
    first = y1 <= y2
    gap, older = F.abs(y2 - y1), F.when(first, age_2 - age_1).otherwise(age_1 - age_2)
    low, high = F.least(source_1, source_2), F.greatest(source_1, source_2)
    tolerance = F.lit(AGE_TOLERANCE_DEFAULT)
    for (a, b), t in AGE_TOLERANCE.items():
        tolerance = F.when((low == a) & (high == b), F.lit(t)).otherwise(tolerance)
    known = (age_1 != 0) & (age_2 != 0) & y1.isNotNull() & y2.isNotNull()
    return F.coalesce(F.when(known, (older >= 0) & (F.abs(older - gap) <= tolerance)), F.lit(True))


def names_match(name_1: Column, name_2: Column) -> Column:
    """Equal, or equal first tokens, or approved variants with equal remaining tokens."""
    a, b = (F.split(F.lower(F.trim(n)), r"\s+") for n in (name_1, name_2))
    rest = lambda x: F.slice(x, 2, 100)
    x, y = F.element_at(a, 1), F.element_at(b, 1)
    return F.coalesce((F.lower(F.trim(name_1)) == F.lower(F.trim(name_2))) | (x == y) | (N.is_variant(x, y) & (rest(a) == rest(b))), F.lit(True))


def violations(side_1: dict[str, Column], side_2: dict[str, Column]) -> Column:
    """Codes of what a pair breaks; each side has name, age and source. Names count only without a gender flip."""
    same = gender_consistent(side_1["name"], side_2["name"])
    codes = F.array(
        F.when(~same, F.lit("gender_flip")),
        F.when(~age_valid(side_1["age"], side_1["source"], side_2["age"], side_2["source"]), F.lit("age_progression")),
        F.when(same & ~names_match(side_1["name"], side_2["name"]), F.lit("name_mismatch")),
    )
    return F.filter(codes, lambda x: x.isNotNull())


def _sides(df: DataFrame) -> Column:
    side = lambda k: {"name": F.col(f"name_{k}"), "age": F.col(f"age_{k}"), "source": F.col(f"source_{k}")}
    return violations(side(1), side(2))


def filter_pairs(pairs: DataFrame, persons: DataFrame) -> DataFrame:
    """Pairs (id_1, id_2, score) of different sources without violation.

    Pairs that have name_k, age_k and source_k for k 1 and 2 are not joined with the persons again."""
    side = lambda k: persons.select(F.col("recorded_person_id").alias(f"id_{k}"), F.col("name_as_recorded").alias(f"name_{k}"), F.col("age").alias(f"age_{k}"), F.col("source_id").alias(f"source_{k}"))
    have = {f"{c}_{k}" for c in ("name", "age", "source") for k in (1, 2)} <= set(pairs.columns)
    both = (pairs if have else pairs.join(side(1), "id_1").join(side(2), "id_2")).filter("source_1 <> source_2")
    a, b = F.col("name_1"), F.col("name_2")
    # no code of `violations`; equal names need no look at them
    named = F.when(a == b, F.lit(True)).otherwise(gender_consistent(a, b) & names_match(a, b))
    ages = age_valid(F.col("age_1"), F.col("source_1"), F.col("age_2"), F.col("source_2"))
    return both.filter(ages & named).select(*pairs.columns)


def sweep(links: DataFrame, persons: DataFrame) -> DataFrame:
    """All pairs of recorded persons within a person, with their violation codes.

    A person has a few recorded persons; rows of the pair join grow with the square of that."""
    rows = links.join(persons, "recorded_person_id").select("person_id", F.struct("recorded_person_id", "name_as_recorded", "age", "source_id").alias("x"))
    pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.person_id") == F.col("b.person_id")) & (F.col("a.x.recorded_person_id") < F.col("b.x.recorded_person_id")))
    cols = [F.col(f"{s}.x.{c}").alias(f"{n}_{k}") for s, k in (("a", 1), ("b", 2)) for c, n in (("recorded_person_id", "recorded_person_id"), ("name_as_recorded", "name"), ("age", "age"), ("source_id", "source"))]
    flat = pairs.select(F.col("a.person_id").alias("person_id"), *cols)
    return flat.withColumn("codes", _sides(flat))


def sweep_report(swept: DataFrame) -> DataFrame:
    """Counts per code, and flagged pairs with their share of all."""
    has = lambda c: F.count_if(F.array_contains("codes", c))
    flagged = F.count_if(F.size("codes") > 0)
    return swept.agg(F.count(F.lit(1)).alias("pairs"), flagged.alias("flagged"), has("gender_flip").alias("gender_flip"), has("age_progression").alias("age_progression"), has("name_mismatch").alias("name_mismatch"), F.round(100 * flagged / F.count(F.lit(1)), 4).alias("violation_pct"))


def remove_flagged(links: DataFrame, swept: DataFrame) -> DataFrame:
    """Links without both sides of every flagged pair."""
    bad = swept.filter(F.size("codes") > 0)
    gone = bad.select("person_id", F.explode(F.array("recorded_person_id_1", "recorded_person_id_2")).alias("recorded_person_id")).distinct()
    return links.join(gone, ["person_id", "recorded_person_id"], "left_anti")


def household_coherence(links: DataFrame, persons: DataFrame) -> DataFrame:
    """Persons twice in one record, or in two records of one census: person_id, kind, n."""
    rows = links.join(persons.select("recorded_person_id", "record_id", "source_id"), "recorded_person_id")
    within = rows.groupBy("person_id", "record_id").count().filter("count > 1").select("person_id", F.lit("same_record").alias("kind"), F.col("record_id").alias("key"), F.col("count").alias("n"))
    census = rows.groupBy("person_id", "source_id").agg(F.countDistinct("record_id").alias("n")).filter("n > 1").select("person_id", F.lit("same_census").alias("kind"), F.col("source_id").cast("long").alias("key"), "n")
    return within.unionByName(census)


def assert_one_per_source(links: DataFrame, persons: DataFrame) -> None:
    """Raises if a person is linked with two recorded persons of one source; called before links are written."""
    rows = links.join(persons.select("recorded_person_id", "source_id"), "recorded_person_id")
    if not rows.groupBy("person_id", "source_id").count().filter("count > 1").isEmpty():
        raise ValueError("a person is linked twice in one source")


def pair_audit(swept: DataFrame, persons: DataFrame) -> DataFrame:
    """Six checks per pair: occupation, role, surname code, age gap, forename, place."""
    from ..functions import text as X

    side = lambda k: persons.select(F.col("recorded_person_id").alias(f"recorded_person_id_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("name_as_recorded", "age", "role", "occupation", "place_id", "source_id")])
    p = swept.select("person_id", "recorded_person_id_1", "recorded_person_id_2").join(side(1), "recorded_person_id_1").join(side(2), "recorded_person_id_2")
    surname = lambda k: X.soundex(X.surname_of(F.col(f"name_as_recorded_{k}")))
    first = lambda k: N.first_token(F.col(f"name_as_recorded_{k}"))
    return p.select(
        "person_id", "recorded_person_id_1", "recorded_person_id_2", (F.col("occupation_1") != F.col("occupation_2")).alias("occupation"),
        F.expr("role_1 in ('head', 'spouse') and role_2 in ('son', 'daughter')").alias("role_inversion"), (surname(1) != surname(2)).alias("surname"),
        (~age_valid(F.col("age_1"), F.col("source_id_1"), F.col("age_2"), F.col("source_id_2"))).alias("age_outlier"),
        ((first(1) != first(2)) & ~N.is_variant(first(1), first(2))).alias("forename"), (F.col("place_id_1") != F.col("place_id_2")).alias("geography"),
    )


def surname_groups(persons: DataFrame) -> DataFrame:
    """Surnames that are the same without apostrophes and spaces, where there are several spellings."""
    from ..functions import text as X

    s = persons.select(X.surname_of(F.col("name_as_recorded")).alias("surname")).filter("surname is not null").distinct()
    return s.groupBy(F.regexp_replace("surname", "[' ]", "").alias("bare")).agg(F.array_sort(F.collect_set("surname")).alias("spellings")).filter(F.size("spellings") > 1)


def first_of(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
