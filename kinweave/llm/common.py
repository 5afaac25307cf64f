"""What the operators share: reading tables, the shared folder, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

#: Words are the runs of characters outside this class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session on one machine that names none gets one in its warehouse;
    on a cluster the folder has to be named, as no local one would do."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir") + "/.scratch"
        spark.sparkContext.setCheckpointDir(named)
    return named


def as_row(docs: DataFrame) -> F.Column:
    """All columns of `docs` as the struct `row`: so no name of theirs meets one of the operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


class Scratch:
    """Tables in the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/kinweave-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        df.write.option("compression", compression).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text) -> F.Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE + "+"), "")), F.lit(0)).cast("long") * F.when(text.isNull(), 0).otherwise(1)


def in_buckets(key, every: int, seed: int) -> F.Column:
    """A seeded bucket 0..every-1 of a row, the same in each run."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(every))


def join_hot(rows: DataFrame, side: DataFrame, key: str, size: str, total: int, most: int = 1000) -> DataFrame:
    """Inner join of rows with `side`, which has one row per `key` and the number of rows that share it in `size`.

    A key that holds more than 1/most of all rows is hot; there are fewer than `most` of them, so they are
    sent to the tasks, and no task gathers a hot key. The rest is joined by key."""
    least = max(1, total // most)
    hot, cold = side.filter(F.col(size) > least), side.filter(F.col(size) <= least)
    few = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(few, key, "left_anti").join(cold, key))


#: Bits of a Bloom filter for each key, its hashes, and the most bits: 16 MB whatever the keys.
BLOOM_BITS, BLOOM_HASHES, BLOOM_MOST = 10, 3, 1 << 27


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's. As a list of rows it would be read by Python workers of its own in each executor."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds), schema)


def bloom(keys: DataFrame, key: str) -> Callable[[np.ndarray], np.ndarray]:
    """A test of an array of longs, to be run by tasks, that holds for all values of `keys[key]` and few others.

    The filter is made by the tasks, a slice each, and sent to all: up to BLOOM_MOST bits. With so many keys that these fill
    up more values pass; so it only ever spares rows a shuffle and decides nothing."""
    spark, n = keys.sparkSession, keys.count()
    bits = min(BLOOM_MOST, 1 << max(13, (BLOOM_BITS * n).bit_length()))
    slice_bits = min(bits, 1 << 19)

    def places(k: np.ndarray) -> np.ndarray:
        """(hash, key) bit numbers: steps of two halves of a mixed key."""
        x = k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        step = (x >> np.uint64(20)) | np.uint64(1)
        return np.stack([(x + step * np.uint64(i)) & np.uint64(bits - 1) for i in range(BLOOM_HASHES)]).astype(np.int64)

    @pandas_udf("array<int>")
    def numbers(k: pd.Series) -> pd.Series:
        return pd.Series(list(places(k.to_numpy(np.int64)).T.astype(np.int32)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(slice_bits, np.uint8)
        on[pdf["place"].to_numpy() % slice_bits] = 1
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "bits": [np.packbits(on).tobytes()]})

    at = keys.select(F.explode(numbers(F.col(key).cast("long"))).alias("place")).distinct()
    filled = at.withColumn("slice", F.expr(f"place div {slice_bits}").cast("int")).groupBy("slice").applyInPandas(fill, "slice int, bits binary")
    table = np.zeros(bits // 8, np.uint8)
    for r in filled.collect():  # at most 16 MB
        a = r["slice"] * slice_bits // 8
        table[a : a + slice_bits // 8] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(table)

    def test(k: np.ndarray) -> np.ndarray:
        p = places(k)
        return ((sent.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=0)

    return test


def may_be_in(keys: DataFrame, key: str):
    """`bloom` as a function of a long column."""
    test = bloom(keys, key)

    @pandas_udf("boolean")
    def of(k: pd.Series) -> pd.Series:
        return pd.Series(test(k.to_numpy(np.int64)))

    return of
