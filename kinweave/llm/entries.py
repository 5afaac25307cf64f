"""The subpackage's queries: one per operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, forest, gru_lm, langid, mixing, packing, secret_scan, simhash, urls, warc
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "url_score")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(table(spark, sf_dir, "documents").withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False)))
    model = langid.fit(docs.filter("not held_out").select("doc_id", "text", "lang"))
    return langid.identify(docs, model).select("doc_id", "held_out", "_lang.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.find(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return forest.judged(docs, table(spark, sf_dir, "labels")).select("doc_id", "_quality.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_secrets.*")


def queries() -> dict:
    import corpus_pipeline

    ops = (op1_mixing, op2_url_filter, op3_language_model, op4_language_id, op5_exact_dedup, op6_quality_rules, op7_simhash, op8_warc, op9_packing, op10_secret_scan)
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
