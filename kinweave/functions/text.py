"""Normalising, phonetic and similarity functions as columns."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Relation to head -> role, after lower-casing and deleting apostrophes.
ROLE_OF = {
    "head": "head of family, head", "spouse": "wife, husband", "son": "son, step son, stepson", "daughter": "daughter, step daughter, stepdaughter",
    "sibling": "sister, brother", "grandchild": "grand son, grandson, grand daughter, granddaughter, grand child, grandchild",
    "in_law": "daughter in law, son in law, mother in law, father in law, sister in law, brother in law, niece in law, sons wife, son wife, brothers wife, nephews wife",
    "niece_nephew": "niece, nephew, nice", "aunt_uncle": "aunt, uncle", "cousin": "cousin", "mother": "mother", "father": "father",
    "servant": "servant, farm servant, house keeper", "visitor": "visitor", "boarder": "boarder, lodger",
}
# What a relation contains -> role, in this order.
ROLE_BY_PART = (("in law", "in_law"), ("grand", "grandchild"), ("servant", "servant"), ("keeper", "servant"), ("boarder", "boarder"), ("lodger", "boarder"))
# Digits of letters.
SOUNDEX_FROM, SOUNDEX_TO = "bfpvcgjkqsxzdtlmnr", "111122222222334556"


def norm(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def collapse(x: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(x)), r"\s+", " ")


def surname_of(name: Column, empty_as_null: bool = True) -> Column:
    last = F.element_at(F.split(norm(name), r"\s+"), -1)
    return F.when(last != "", last) if empty_as_null else last


def forename_of(name: Column) -> Column:
    """All but the last token; a single token is its own forename."""
    parts = F.split(norm(name), r"\s+")
    some = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), " ")).otherwise(F.element_at(parts, 1))
    return F.when(some != "", some)


def soundex(name: Column, null_as_empty: bool = False) -> Column:
    """Four characters; a leading O before a consonant and a leading Mac are dropped, and vowels don't break runs."""
    letters = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}]", "")
    cut = F.when(letters.rlike("^o[^aeiou]"), F.substring(letters, 2, 1000)).when(letters.startswith("mac"), F.substring(letters, 4, 1000)).otherwise(letters)
    cut = F.when(cut == "", letters).otherwise(cut)
    digits = F.regexp_replace(F.translate(F.substring(cut, 2, 1000), SOUNDEX_FROM, SOUNDEX_TO), "[^1-6]", "")
    digits = F.regexp_replace(digits, r"([1-6])\1+", "$1")
    code = F.rpad(F.concat(F.upper(F.substring(cut, 1, 1)), F.substring(digits, 1, 3)), 4, "0")
    return F.when(cut != "", code).otherwise(F.lit("") if null_as_empty else F.lit(None).cast("string"))


def map_role(relation: Column) -> Column:
    """Role of a relation to the head of household; null where blank, unknown where no rule fits."""
    key = F.regexp_replace(F.regexp_replace(F.trim(F.lower(relation)), "'", ""), r"\s+", " ")
    role = F.lit("unknown")
    for part, name in reversed(ROLE_BY_PART):
        role = F.when(key.contains(part), F.lit(name)).otherwise(role)
    for name, said in ROLE_OF.items():
        role = F.when(key.isin(*said.split(", ")), F.lit(name)).otherwise(role)
    return F.when(F.coalesce(key, F.lit("")) != "", role)


def parse_age(age: Column) -> Column:
    """Whole part of a number; null where it is none, or not finite."""
    number = F.trim(age).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 1000), number.cast("int"))


def parse_age_range(age: Column) -> Column:
    """The lower end of a range such as 30-35, or the age itself."""
    return parse_age(F.element_at(F.split(age, "-"), 1))


def normalise_place(place: Column) -> Column:
    """First of alternatives, abbreviations written out, place-type words and doubled consonants gone."""
    s = F.lower(place)
    s = F.trim(F.element_at(F.split(s, " or "), 1))
    s = F.regexp_replace(s, r"[,.\-]", " ")
    for short, long in (("co", "county"), ("par", "parish"), ("bal", "bally"), ("td", "townland")):
        s = F.regexp_replace(s, rf"\b{short}\b\.?", long)
    s = F.regexp_replace(s, r"\b(townland|civil parish|ded|barony|county|parish)\b", "")
    s = F.regexp_replace(s, r"([bcdfghjklmnpqrstvwxyz])\1+", "$1")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def year_of(date: Column) -> Column:
    """Leading four digits of a partial date."""
    return F.when(date.rlike("^[0-9]{4}"), F.substring(date, 1, 4).cast("int"))


def pair_label(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit("↔"), F.greatest(a, b))


def overlap(a: Column, b: Column) -> Column:
    """Szymkiewicz-Simpson: common elements over the smaller set; null if a set is empty or null."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


def person_label(name: Column, place: Column) -> Column:
    return F.when(place.isNull(), name).otherwise(F.concat(name, F.lit(" ("), place, F.lit(")")))


def fill_url(template: Column, values: dict[str, Column]) -> Column:
    for key, value in values.items():
        template = F.replace(template, F.lit("{" + key + "}"), F.coalesce(value, F.lit("")))
    return template


def jaro_winkler_of(a: str | None, b: str | None, weight: float = 0.1, floor: float = 0.7) -> float | None:
    """Jaro-Winkler similarity; the prefix counts only above `floor`."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0 if a else 0.0
    n, m = len(a), len(b)
    reach = max(n, m) // 2 - 1
    free, common, at = [True] * m, [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                common.append(c)
                at.append(j)
                break
    k = len(common)
    if not k:
        return 0.0
    swapped = sum(x != b[j] for x, j in zip(common, sorted(at), strict=True)) // 2
    jaro = (k / n + k / m + (k - swapped) / k) / 3
    if jaro <= floor:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(n, m, 4))
    return jaro + weight * prefix * (1 - jaro)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler of two columns, in Arrow batches: about ten times as fast as higher-order functions."""

    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler_of(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return pandas_udf(score, "double")(a, b)


#: Rows of a table that may be sent to every task, rather than have the pairs shuffled to it.
SENT_ROWS = 1_000_000


def with_similarity(pairs: DataFrame, left: str, right: str, name: str, least: float | None = None) -> DataFrame:
    """Adds the Jaro-Winkler similarity to nine digits, scored once for each distinct pair of values; null under `least`.

    Scores of up to SENT_ROWS pairs of values go to the tasks, and the pairs of rows stay where they are made; only
    with more of them are these shuffled."""
    from ..operators.cluster import sent

    values = pairs.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()
    scored = values.withColumn(name, F.round(jaro_winkler(F.col(left), F.col(right)), 9))
    if least is not None:  # most pairs of values are unlike, and the driver holds what is sent
        scored = scored.filter(F.col(name) >= least)
    return pairs.join(sent(scored, SENT_ROWS), [left, right], "left")


def notes(parts: Iterable[Column]) -> Column:
    """Notes joined by semicolons, null where there is none."""
    text = F.concat_ws("; ", *parts)
    return F.when(text != "", text)
