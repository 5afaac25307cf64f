"""Incremental ingest: new extract files become evidence, and new recorded persons are linked against all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def ingest_stream(spark: SparkSession, folder: str, schema: T.StructType, out: str, checkpoint: str, step: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """Reads new CSV files of `folder` and writes each batch under `out`, once, after `step`."""
    files = spark.readStream.option("header", True).schema(schema).csv(folder).withColumn("file", F.input_file_name())

    def land(batch: DataFrame, number: int) -> None:
        done = step(batch, number) if step else batch
        # a batch that is run again overwrites itself
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type in tumbling windows; rows later than `late` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
