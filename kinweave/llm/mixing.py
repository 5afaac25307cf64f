"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's tokens are dealt to shards, each shard is cut into blocks of nearly equal length, and
blocks are the seats: sources get seats by the highest quotients target/(2s+1), then each source's
seats go to its shards the same way, and a seeded permutation picks the blocks of a shard.

Nulls: a null source is a source of its own, last in order; a null text has size 0. Texts without
words take 0. Repeated rows are rows of their own. An empty table gives an empty plan. Only the
named columns are read; others may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, as_row, word_count

#: Primes above any number of blocks in a shard, so that k -> a*k+c permutes the blocks.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


#: SQL for the blocks that meet a document: times taken, and from lo to hi in the shard's tokens.
_BLOCK = "named_struct('times', quota div blocks + if((mul * k + add) % blocks < quota % blocks, 1L, 0L), 'lo', greatest((k * shard_size) div blocks, start), 'hi', least(((k + 1) * shard_size) div blocks, start + size))"
BLOCKS = f"if(size > 0, transform(sequence(((start + 1) * blocks - 1) div shard_size, ((start + size) * blocks - 1) div shard_size), k -> {_BLOCK}), array())"


def apportion(leaves: DataFrame, group: str, leaf: str, weight: str, seats: str) -> DataFrame:
    """Sainte-Laguë: adds integer `quota` to each leaf; the quotas of a group add up to its `seats`.

    Rounding by the mean quotient is off by at most half the number of leaves; the seats missing are
    given to the highest next quotients, the excess is taken from the lowest last ones. A leaf's seats
    change by at most 1 + x*n/2m, so the candidates are about twice the leaves. Ties: the smaller leaf (a number)
    is first to gain and last to lose.
    Zero weights get no seat.
    """
    w = Window.partitionBy(group)
    x = F.when(F.col("_tot") > 0, F.col(weight) * F.col(seats) / F.col("_tot")).otherwise(F.lit(0.0))
    step = leaves.withColumn("_tot", F.sum(weight).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    step = step.withColumn("_x", x).withColumn("_a", F.floor(F.col("_x") + 0.5))
    step = step.withColumn("_e", F.when(F.col("_tot") > 0, F.col(seats)).otherwise(0) - F.sum("_a").over(w))
    more = F.least(F.lit(1) + F.ceil(F.col("_x") * F.col("_n") / (2 * F.greatest(F.col(seats), F.lit(1)))), F.abs(F.col("_e")))
    tries = F.when((F.col("_e") != 0) & (F.col(weight) > 0), F.sequence(F.lit(1).cast("long"), F.greatest(more, F.lit(1)).cast("long")))
    keep = leaves.columns
    tried = step.withColumn("_j", F.explode_outer(tries))
    seat = F.when(F.col("_e") > 0, F.col("_a") + F.col("_j")).otherwise(F.col("_a") - F.col("_j") + 1)
    tried = tried.withColumn("_s", seat).withColumn("_ok", F.col("_j").isNotNull() & (F.col("_s") >= 1))
    quotient = F.col(weight) / (2 * F.col("_s") - 1)
    order = Window.partitionBy(group).orderBy(F.col("_ok").desc(), F.when(F.col("_e") > 0, -quotient).otherwise(quotient), F.when(F.col("_e") > 0, F.col(leaf)).otherwise(-F.col(leaf)))
    hit = (F.col("_ok") & (F.row_number().over(order) <= F.abs(F.col("_e")))).cast("long")
    done = tried.withColumn("_hit", hit).groupBy(*keep, "_a", "_e").agg(F.sum("_hit").alias("_hits"))
    return done.select(*keep, (F.col("_a") + F.signum(F.col("_e")).cast("long") * F.col("_hits")).cast("long").alias("quota"))


def targets(sources: DataFrame, weights=(3, 1, 2), share=1.5, cap=2.0) -> DataFrame:
    """Adds `sid` (rank by code point, null last), `w` and `target` to one row per source.

    Water filling: targets are w*level, stopped at cap*size; each round reshares the excess among the
    open sources by weight, and ends when none is above. One small aggregate per round; the source
    table has one row per source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    s = sources.withColumn("sid", F.row_number().over(order).cast("long"))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    spark, top, level = sources.sparkSession, F.col("source_size") * F.lit(float(cap)), 0.0
    s = Scratch(spark).save(s, "sources")
    while True:
        full = top <= F.col("w") * F.lit(level)
        r = s.agg(F.sum("source_size").alias("t"), F.sum(F.when(full, top)).alias("f"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        new = (share * (r["t"] or 0) - (r["f"] or 0.0)) / r["w"] if r["w"] else level
        if new <= level:
            break
        level = new
    return s.withColumn("target", F.least(F.col("w") * F.lit(level), top).cast("double"))


def plan(docs: DataFrame, weights=(3, 1, 2), share=1.5, cap=2.0, block_tokens=128, shard_tokens=65536, seed=17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and what selects its blocks
    (start, shard_size, blocks, quota, mul, add) with `thash`, a hash of the text.

    Each shard is one window. A source of n words has n/`shard_tokens` of them, from `shard_tokens`**2 words on the root of n:
    then shards grow as fast in size as in number, so neither a shard nor the list of a source's shards becomes the large one."""
    spark = docs.sparkSession
    hold = Scratch(spark)
    sizes = hold.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("thash")), "sizes")
    src = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    src = src.withColumn("shards", F.greatest(F.ceil(F.least(F.col("source_size") / shard_tokens, F.sqrt("source_size"))), F.lit(1)).cast("long"))
    src = hold.save(src, "targets")
    # one row per source; sent whole to the tasks only while that is provably small
    side = F.broadcast(src) if src.limit(20_001).count() <= 20_000 else src
    rows = sizes.join(side.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "thash"), F.col("shards")))
    w = Window.partitionBy("sid", "shard")
    run = w.orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size", "thash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.sum("size").over(run) - F.col("size")).withColumn("shard_size", F.sum("size").over(w))
    cut = F.when(F.col("shard_size") > 0, F.greatest(F.round(F.col("shard_size") / block_tokens), F.lit(1))).otherwise(0).cast("long")
    rows = hold.save(rows.withColumn("blocks", cut), "rows")
    shard = rows.groupBy("sid", "shard").agg(F.max("shard_size").alias("shard_size"), F.max("blocks").alias("blocks"), F.max("target").alias("target"))
    shard = hold.save(shard, "shards")
    seats = shard.groupBy("sid").agg(F.sum("blocks").alias("blocks"), F.sum("shard_size").alias("size"), F.max("target").alias("target"))
    seats = seats.withColumn("want", F.when(F.col("size") > 0, F.col("target") * F.col("blocks") / F.col("size")).otherwise(F.lit(0.0)))
    seats = seats.withColumn("all", F.lit(0)).withColumn("seats", F.round(F.sum("want").over(Window.partitionBy("all"))).cast("long"))
    given = apportion(seats.select("all", "sid", "blocks", "want", "seats"), "all", "sid", "want", "seats")
    given = given.select("sid", F.least(F.col("quota"), (F.lit(cap) * F.col("blocks")).cast("long")).alias("seats"))
    parts = apportion(shard.select("sid", "shard", "blocks").join(given, "sid").withColumn("_wt", F.col("blocks").cast("double")), "sid", "shard", "_wt", "seats")
    pick = F.xxhash64(F.lit(seed + 2), "sid", "shard")
    parts = parts.select(
        "sid", "shard", F.least(F.col("quota"), (F.lit(cap) * F.col("blocks")).cast("long")).alias("quota"),
        F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(pick, F.lit(len(PRIMES))) + 1).cast("int")).alias("mul"),
        F.pmod(F.shiftright(pick, 8), F.greatest(F.col("blocks"), F.lit(1))).alias("add"),
    )
    return rows.join(parts, ["sid", "shard"]).withColumn("taken", F.expr(f"aggregate({BLOCKS}, 0L, (acc, b) -> acc + b.times * (b.hi - b.lo))"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents, with the columns of `docs`: the words of a document that are taken once or more,
    then those taken twice, and so on, each as a row of its own with its text (whole where all is taken).
    n_chars, where there is one, is that text's length. Rows equal in doc_id and text share one selection."""
    chosen = plan(docs, **how).filter("taken > 0").withColumn("_b", F.expr(BLOCKS))
    chosen = chosen.groupBy("doc_id", "thash").agg(F.min_by(F.struct("_b", "start", "size"), F.struct("start", "source", "shard")).alias("p"))
    chosen = chosen.select(F.col("doc_id").alias("id"), F.col("thash").alias("its"), "p")
    rows = docs.select(as_row(docs), "doc_id", F.xxhash64("text").alias("thash"))
    both = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("thash") == F.col("its"))).select("row", "p")
    both = both.withColumn("pass", F.explode(F.expr("sequence(1L, array_max(transform(p._b, b -> b.times)))")))
    both = both.withColumn("inside", F.expr("filter(p._b, b -> b.times >= pass and b.hi > b.lo)"))
    # pieces of a word and the space after it; the first piece also holds what stands before the first word
    both = both.withColumn("w", F.regexp_extract_all("row.text", F.lit(rf"({SPACE}*[^\x20\x09-\x0D]+)"), 1))
    whole = F.expr("aggregate(inside, 0L, (a, b) -> a + b.hi - b.lo) = p.size")
    text = F.expr("trim(array_join(flatten(transform(inside, b -> slice(w, cast(b.lo - p.start + 1 as int), cast(b.hi - b.lo as int)))), ''))")
    both = both.select("row", F.when(whole, F.col("row.text")).otherwise(text).alias("text"))
    fields = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return both.select(*[fields.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
