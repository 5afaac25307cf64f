"""Exact duplicates by exchange of Golomb-coded fingerprints.

Each sender sorts the fingerprints of its rows, Rice-codes the gaps and sends each range to its owner;
owners answer with a bitmap of the fingerprints that other senders hold too. Only the suspects' texts are
then shuffled and compared byte by byte.

Texts are equal when identical without the characters of `[\\x20\\x09-\\x0D]`; null counts as empty. Of
equal texts the row with the most code points, then the smallest doc_id, stays; of repeated rows (same
doc_id and text) one stays. A null doc_id sorts before all others. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, as_row, join_hot, may_be_in

#: Fingerprints that a sender holds: the least, the most, and the number of senders beyond which they grow.
ROWS_PER_SENDER, MOST_PER_SENDER, SENDERS = 50_000, 1_000_000, 4096


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """(k, unary part, remainders) of sorted distinct values: gaps are quotients in unary and k-bit remainders."""
    gaps = np.diff(values, prepend=values[:1] * 0).astype(np.uint64)
    k = max(0, int(np.log2(max(1.0, float(gaps.mean())))))
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    bits = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(bits).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n] + 1
    quotients = (np.diff(ends, prepend=0) - 1).astype(np.uint64)
    gaps = quotients << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
        gaps |= (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _fingerprints(docs: DataFrame) -> DataFrame:
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, "")
    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), bare.alias("bare"))
    return rows.select("doc_id", "n_points", F.xxhash64("bare").alias("h"), F.sha2("bare", 256).alias("sha"))


def suspects(rows: DataFrame, hold: Scratch) -> DataFrame:
    """Adds `suspect` to rows with `h` and `sender`: another row has the same fingerprint of `bits` bits.

    A sender and an owner hold from ROWS_PER_SENDER to MOST_PER_SENDER fingerprints. Above SENDERS senders they
    hold more rather than become more, as messages go by the square of the senders. A fingerprint is sent once
    by each sender, so a hot text costs its owner one entry per sender."""
    n = max(1, rows.count())
    parts = 1 << int(np.ceil(np.log2(max(1, n / min(MOST_PER_SENDER, max(ROWS_PER_SENDER, n // SENDERS))))))
    width = int(np.log2(parts))
    bits = min(62, max(32, 2 * int(np.ceil(np.log2(n + 1))) + 8))
    low = bits - width

    def short(h: pd.Series) -> np.ndarray:
        return h.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(short(pdf["h"]))
        out = []
        cuts = np.searchsorted(own, np.arange(parts + 1, dtype=np.uint64) << np.uint64(low))
        for owner in np.flatnonzero(np.diff(cuts)):
            part = own[cuts[owner] : cuts[owner + 1]] & np.uint64((1 << low) - 1)
            out.append((int(owner), int(pdf["sender"].iloc[0]), len(part), *rice_encode(part)))
        return pd.DataFrame(out, columns=["owner", "sender", "n", "k", "unary", "rest"])

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [rice_decode(r.n, r.k, r.unary, r.rest) for r in pdf.itertuples()]
        _, at, times = np.unique(np.concatenate(got), return_inverse=True, return_counts=True)
        many, ends = times[at] > 1, np.cumsum([len(x) for x in got])
        maps = [np.packbits(x).tobytes() for x in np.split(many, ends[:-1])]
        return pd.DataFrame({"sender": pdf["sender"].to_numpy(), "owner": pdf["owner"].to_numpy(), "n": pdf["n"].to_numpy(), "bitmap": maps})

    def mark(mine: pa.Table, maps: pa.Table) -> pa.Table:
        own, at, times = np.unique(short(mine["h"].to_pandas()), return_inverse=True, return_counts=True)
        answers = sorted(zip(*(maps[c].to_pylist() for c in ("owner", "n", "bitmap")), strict=True))
        many = [np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n].astype(bool) for _, n, bitmap in answers]
        elsewhere = np.concatenate(many) if many else np.zeros(0, bool)
        return mine.drop_columns("sender").append_column("suspect", pa.array(((times > 1) | elsewhere)[at]))

    rows = rows.withColumn("sender", F.pmod(F.xxhash64("doc_id", "h"), F.lit(parts)).cast("int"))
    sent = rows.select("sender", "h").groupBy("sender").applyInPandas(send, "owner int, sender int, n int, k int, unary binary, rest binary")
    answers = sent.groupBy("owner").applyInPandas(own, "sender int, owner int, n int, bitmap binary")
    schema = ", ".join(f"{c} {t}" for c, t in rows.drop("sender").dtypes) + ", suspect boolean"
    return hold.save(rows.groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(mark, schema), "marked")


def find(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_points, h, text_sha256, keep_id, group_size, kept."""
    hold = Scratch(docs.sparkSession)
    rows = suspects(hold.save(_fingerprints(docs), "rows"), hold)
    # what no suspect's fingerprint can be stays where it is
    suspected = may_be_in(rows.filter("suspect").select("h").distinct(), "h")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("bare", F.regexp_replace("text", SPACE, ""))
    texts = texts.filter(suspected(F.xxhash64("bare")))
    # the bytes themselves are the key; equal texts of a task are counted before they are shuffled
    first = F.struct((-F.length("text")).alias("n"), "doc_id")
    groups = texts.groupBy("bare").agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("keep"))
    groups = hold.save(groups.select(F.sha2("bare", 256).alias("sha"), "group_size", F.col("keep.doc_id").alias("keep_id"), (-F.col("keep.n")).cast("long").alias("keep_points")), "groups")
    alone = rows.filter("not suspect").select("doc_id", "n_points", "h", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    both = join_hot(rows.filter("suspect").drop("suspect"), groups, "sha", "group_size", rows.count())
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    away = both.filter(~stays).withColumn("kept", F.lit(False))
    # rows repeated as they are: one of them stays
    turn = F.row_number().over(Window.partitionBy("sha", "doc_id").orderBy("n_points"))
    stay = both.filter(stays).withColumn("kept", turn == 1)
    out = alone.unionByName(away.drop("keep_points")).unionByName(stay.drop("keep_points"))
    return out.withColumnRenamed("sha", "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """`docs` without the copies that find() drops, all columns kept, whatever their names.

    Only rows that a filter takes for dropped ones are shuffled, to be compared with these."""
    hold, text = Scratch(docs.sparkSession), F.coalesce("text", F.lit(""))
    gone = find(docs).filter("not kept").select("doc_id", "h", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again"), "n_points").distinct()
    gone = hold.save(gone.withColumn("key", F.xxhash64("doc_id", "n_points")), "gone")
    dropped = may_be_in(gone.select("key"), "key")
    rows = docs.select(as_row(docs), "doc_id", F.length(text).cast("long").alias("n_points"))
    rows = rows.withColumn("asked", dropped(F.xxhash64("doc_id", "n_points")))
    some = rows.filter("asked").withColumn("h", F.xxhash64(F.regexp_replace(F.coalesce("row.text", F.lit("")), SPACE, "")))
    same = F.col("doc_id").eqNullSafe(F.col("_g.doc_id")) & (F.col("h") == F.col("_g.h")) & (F.col("n_points") == F.col("_g.n_points"))
    of = lambda df: df.select(F.struct("doc_id", "h", "n_points").alias("_g"))
    stay = some.join(of(gone.filter("not again")), same, "left_anti")
    again = of(gone.filter("again"))
    # of a kept row that is repeated one stays
    once = stay.join(again, same, "left_semi").dropDuplicates(["doc_id", "h"])
    kept = rows.filter("not asked").select("row").unionByName(stay.join(again, same, "left_anti").select("row")).unionByName(once.select("row"))
    return kept.select("row.*")
