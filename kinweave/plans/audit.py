"""Append-only audit log and timing of steps."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ENTITY_TYPES, LOG_ACTIONS, STAGES

LOG = "reviewer_id long, action string, entity_type string, entity_id long, field_name string, old_value string, new_value string, reason string, change_group_id string, created_at timestamp"


def _entry(df: DataFrame, action: str, entity: str, reviewer: int, reason: str | None, group: str | None) -> DataFrame:
    if action not in LOG_ACTIONS or entity not in ENTITY_TYPES:
        raise ValueError(f"unknown action or entity: {action}, {entity}")
    return df.select(
        F.lit(reviewer).cast("long").alias("reviewer_id"), F.lit(action).alias("action"), F.lit(entity).alias("entity_type"), F.col("entity_id").cast("long").alias("entity_id"), "field_name", "old_value", "new_value",
        F.lit(reason).cast("string").alias("reason"), F.lit(group or uuid.uuid4().hex).alias("change_group_id"), F.current_timestamp().alias("created_at"),
    )


def created(rows: DataFrame, entity: str, id_col: str, reviewer: int = 1, reason: str | None = None, group: str | None = None) -> DataFrame:
    """One entry per field of each created row; null fields have none."""
    fields = [c for c in rows.columns if c != id_col]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in fields]))
    flat = rows.select(F.col(id_col).alias("entity_id"), pairs.alias("f")).filter("f.v is not null")
    return _entry(flat.select("entity_id", F.col("f.k").alias("field_name"), F.lit(None).cast("string").alias("old_value"), F.col("f.v").alias("new_value")), "create", entity, reviewer, reason, group)


def updated(old: DataFrame, new: DataFrame, entity: str, id_col: str, reviewer: int = 1, reason: str | None = None, group: str | None = None) -> DataFrame:
    """One entry per field that differs."""
    fields = [c for c in new.columns if c != id_col and c in old.columns]
    both = old.select(id_col, *[F.col(c).cast("string").alias(f"o_{c}") for c in fields]).join(new.select(id_col, *[F.col(c).cast("string").alias(f"n_{c}") for c in fields]), id_col)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"o_{c}").alias("o"), F.col(f"n_{c}").alias("n")) for c in fields]))
    flat = both.select(F.col(id_col).alias("entity_id"), pairs.alias("f")).filter(~F.col("f.o").eqNullSafe(F.col("f.n")))
    return _entry(flat.select("entity_id", F.col("f.k").alias("field_name"), F.col("f.o").alias("old_value"), F.col("f.n").alias("new_value")), "update", entity, reviewer, reason, group)


def noted(ids: DataFrame, action: str, entity: str, id_col: str, reviewer: int = 1, reason: str | None = None, group: str | None = None) -> DataFrame:
    """One entry per row, for delete, verify and flag."""
    none = F.lit(None).cast("string")
    return _entry(ids.select(F.col(id_col).alias("entity_id"), none.alias("field_name"), none.alias("old_value"), none.alias("new_value")), action, entity, reviewer, reason, group)


def append(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def history(log: DataFrame, entity: str | None = None, entity_id: int | None = None, group: str | None = None, reviewers: DataFrame | None = None) -> DataFrame:
    """The log with the filters that are given, in order; with reviewers' names if their table is."""
    if entity:
        log = log.filter(F.col("entity_type") == entity)
    if entity_id is not None:
        log = log.filter(F.col("entity_id") == entity_id)
    if group:
        log = log.filter(F.col("change_group_id") == group)
    if reviewers is not None:
        log = log.join(reviewers.select("reviewer_id", F.col("name").alias("reviewer")), "reviewer_id", "left")
    return log.orderBy("created_at", "entity_id", "field_name")


class Timer:
    """Times a step and keeps a row for the run table.

    with Timer(spark, "similarity", "block", path): ..."""

    def __init__(self, spark: SparkSession, stage: str, step: str, path: str | None = None, source_id: int | None = None):
        if stage not in STAGES:
            raise ValueError(f"unknown stage: {stage}")
        self.spark, self.stage, self.step, self.path, self.source_id = spark, stage, step, path, source_id

    def __enter__(self):
        self.start = time.time()
        return self

    def __exit__(self, kind, value, trace):
        self.seconds = time.time() - self.start
        self.row = (uuid.uuid4().hex, self.stage, self.step, self.source_id, float(self.seconds), kind is None)
        if self.path:
            df = self.spark.createDataFrame([self.row], "run_id string, stage string, step string, source_id int, seconds double, ok boolean")
            df.withColumn("start_at", F.current_timestamp()).write.mode("append").parquet(self.path)
        return False


#: What each scope of clearing removes, in the order of dependence.
SCOPES = {
    "conclusions": ["event_record", "person_event", "event", "relationship_recorded_relationship", "relationship", "person_recorded_person", "person", "conclusion_log"],
    "scoring": ["person_recorded_person", "person", "record_similarity", "similarity"],
    "evidence": ["recorded_relationship", "record_similarity", "place_record", "recorded_person", "record"],
}


def clear(spark: SparkSession, folder: str, scope: str) -> list[str]:
    """Deletes the tables of a scope under a folder; evidence takes the conclusions with it."""
    names = (SCOPES["conclusions"] if scope == "evidence" else []) + SCOPES[scope]
    gone = []
    for n in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True):
            gone.append(n)
    return gone
