"""Persons from similar recorded persons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PERSON_RESOLUTION_THRESHOLD
from ..functions import names as N
from ..functions import text as X
from .cluster import connected_components, forget, held, purge_same_source, star_edges
from .constraints import filter_pairs


def modal(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key and its most frequent non-null value; ties: the smallest."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(key, column).count()
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("count")).alias("n"), column)).alias("m")).select(key, F.col(f"m.{column}").alias(column))


def gender_of(rows: DataFrame, key: str = "person_id") -> DataFrame:
    """M or F by majority of recorded sexes, then of names' genders; null on a tie."""
    sex = F.upper(F.substring(F.trim("sex_as_recorded"), 1, 1))
    named = N.infer_gender(F.col("name_as_recorded"))
    n = lambda c, v: F.count_if(c == v)
    vote = lambda m, f: F.when(m > f, "M").when(f > m, "F")
    agg = rows.groupBy(key).agg(n(sex, "M").alias("m"), n(sex, "F").alias("f"), n(named, "M").alias("nm"), n(named, "F").alias("nf"))
    return agg.select(key, F.coalesce(vote(F.col("m"), F.col("f")), F.when((F.col("m") == 0) & (F.col("f") == 0), vote(F.col("nm"), F.col("nf")))).alias("gender"))


def describe(links: DataFrame, persons: DataFrame) -> DataFrame:
    """person_id, label (modal name, with modal place), gender and status of linked persons."""
    rows = links.join(persons, "recorded_person_id")
    label = modal(rows, "person_id", "name_as_recorded").join(modal(rows, "person_id", "place_as_recorded"), "person_id", "left")
    return label.join(gender_of(rows), "person_id", "left").select("person_id", X.person_label(F.col("name_as_recorded"), F.col("place_as_recorded")).alias("label"), "gender", F.lit("active").alias("status"))


def resolve(pairs: DataFrame, persons: DataFrame, threshold: float = PERSON_RESOLUTION_THRESHOLD) -> DataFrame:
    """Links (person_id, recorded_person_id, score) from similar pairs (id_1, id_2, score).

    Pairs under the threshold, within a source or against a constraint go before clustering; members that
    share a source with another of their cluster go after. Pairs may bring what filter_pairs needs (see there). The person's id is its smallest recorded person."""
    good = filter_pairs(pairs.filter(F.col("score") >= threshold), persons)
    # pairs are made once and not held: of each task, an edge and the best score per recorded person stay
    stars = held(star_edges(good.select(F.col("id_1").alias("u"), F.col("id_2").alias("v"), "score"), weight="score"))
    found = connected_components(stars, "u", "v")
    best = stars.groupBy(F.col("u").alias("node")).agg(F.max("w").alias("score"))
    members = found.join(best, "node").join(persons.select("recorded_person_id", "source_id"), F.col("node") == F.col("recorded_person_id"))
    kept = held(purge_same_source(members, "component", "source_id").select("component", "recorded_person_id", "score"))
    forget(stars)
    ids = kept.groupBy("component").agg(F.min("recorded_person_id").alias("person_id"))
    return kept.join(ids, "component").select("person_id", "recorded_person_id", "score")
