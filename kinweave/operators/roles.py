"""Role pairs within a household."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ROLE_PAIR_VERSION, ROLE_RULES


def rules(spark) -> DataFrame:
    rows = [(min(a, b), max(a, b), kind, score) for a, b, kind, score in ROLE_RULES]
    return spark.createDataFrame(rows, "role_low string, role_high string, type string, score double")


def role_pairs(persons: DataFrame) -> DataFrame:
    """One row per related pair of a record: ids in order, type, score, version.

    Persons meet by record_id only; a household is small, and the rule table (eleven rows) is broadcast."""
    a = persons.filter("role is not null").select("record_id", F.col("recorded_person_id").alias("recorded_person_id_1"), F.col("role").alias("role_1"))
    b = a.select("record_id", F.col("recorded_person_id_1").alias("recorded_person_id_2"), F.col("role_1").alias("role_2"))
    pairs = a.join(b, "record_id").filter("recorded_person_id_1 < recorded_person_id_2")
    pairs = pairs.withColumn("role_low", F.least("role_1", "role_2")).withColumn("role_high", F.greatest("role_1", "role_2"))
    found = pairs.join(F.broadcast(rules(persons.sparkSession)), ["role_low", "role_high"])
    return found.select("record_id", "recorded_person_id_1", "recorded_person_id_2", "type", "score", F.lit(ROLE_PAIR_VERSION).alias("score_version"))


def pair_counts(persons: DataFrame) -> DataFrame:
    """Per record: pairs with a null role, pairs without a rule, pairs with one."""
    n = persons.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count("role").alias("k"))
    hit = role_pairs(persons).groupBy("record_id").agg(F.count(F.lit(1)).alias("related"))
    both = n.join(hit, "record_id", "left").withColumn("related", F.coalesce("related", F.lit(0)))
    pairs = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("long")
    return both.select("record_id", (pairs("n") - pairs("k")).alias("skipped_null"), (pairs("k") - F.col("related")).alias("no_rule"), "related")
