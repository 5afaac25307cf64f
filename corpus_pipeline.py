"""The corpus pipeline: quality rules, exact and near duplicates, mixing, packing.

Each stage takes the documents that its predecessor kept, reread from Parquet, and returns documents with the
same columns; the last returns packed pieces. In all stages a null text counts as empty, null and repeated doc_ids
keep their rows apart, columns may have any name, whole texts are read however long, and an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import exact, forest, mixing, packing, simhash
from kinweave.llm.common import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the base rules or the forest's verdict; empty texts go, repeated rows are judged alike."""
    return forest.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the one with the most code points stays, of ties the smallest doc_id (null first)."""
    return exact.drop_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose SimHash fingerprints link at two or fewer bits the smallest doc_id stays, null last; of equal ids any one."""
    return simhash.drop_linked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: what is taken twice is two rows; a null source is one of its own, texts without words take none."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset; only longer documents are cut, repeated rows are pieces of their own."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The quality forest, SimHash and the tokenizer have no SQL form; a brute-force version in tests/llm stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    hold, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = hold.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
