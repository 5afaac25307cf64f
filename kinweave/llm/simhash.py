"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming verification, components.

Texts are lower-cased in A-Z and cut into words; repeats of a 3-word shingle count each time. Fewer than
three words are one shingle; a text without words (or null) has fingerprint zero, linked like any other.
A component's id is the smallest doc_id in it (a null doc_id counts as smallest only where it is alone).
Repeated rows share a fingerprint and so a component. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import Scratch, as_row, join_hot, may_be_in

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BATCH = 1 << 16


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text, from XXH64 of its shingles; memory stays at BATCH hashes for any length."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    stops = ends[-n:].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest, over = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BATCH):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BATCH], stops[at : at + BATCH], strict=True)], ">u8")
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(over * 2 > n).tobytes(), "big")


def fingerprint(text) -> F.Column:
    """Signed 64-bit fingerprint of a text column."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))

    return pandas_udf(of, "long")(text)


def block_keys(fp, distance: int = 2, blocks: int = 4) -> F.Column:
    """Array of keys; fingerprints within `distance` bits agree in blocks-distance of the blocks, so in one key.

    A key is the fingerprint with the bits of the other blocks cleared, and the number of the choice."""
    width = 64 // blocks
    masks = [sum(((1 << width) - 1) << (width * b) for b in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(i).cast("byte").alias("choice"), fp.bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks)])


def link_block(fps: np.ndarray, distance: int = 2) -> list[tuple[int, int]]:
    """Edges that join what is linked within one block, at most one per fingerprint; whole rows at a time."""
    fps = fps.view(np.uint64)
    todo, edges = np.arange(len(fps)), []
    while len(todo):
        front, todo = todo[:1], todo[1:]
        root = front[0]
        while len(front) and len(todo):
            near = np.zeros(len(todo), bool)
            for x in fps[front]:
                near |= np.bitwise_count(fps[todo] ^ x) <= distance
            edges += [(int(root), int(j)) for j in todo[near]]
            front, todo = todo[near], todo[~near]
    return edges


def links(fps: DataFrame, distance: int = 2, blocks: int = 4, direct: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`, enough to join all that link.

    Each block is read as a sorted run. A run up to `direct` is compared in memory; a longer one is not:
    its members get an edge to each of their one-bit neighbours, and two fingerprints are within two bits
    exactly if they share a neighbour or one is the other's neighbour. So edges are linear in the rows for
    any block, and no pair is lost. (For distances other than 2 a long run is compared in memory too.)"""

    def run(batches):
        held_key, held, spilled = None, [], False
        ones = np.uint64(1) << np.arange(64, dtype=np.uint64)

        def neighbours(part):
            a = np.repeat(part.view(np.uint64), 64)
            b = (part.view(np.uint64)[:, None] ^ ones[None, :]).ravel()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def compare(part):
            found = np.array(link_block(part, distance), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(part[found[:, 0]]), pa.array(part[found[:, 1]])], ["a", "b"])

        for batch in batches:
            key = np.stack([batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy()], axis=1)
            fp = batch.column(2).to_numpy()
            if not len(fp):
                continue
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            starts, stops = [0, *cuts.tolist()], [*cuts.tolist(), len(fp)]
            small = []
            for a, b in zip(starts, stops, strict=True):
                this = (int(key[a, 0]), int(key[a, 1]))
                if this != held_key:
                    if len(held) > 1 and not spilled:
                        small.append(compare(np.array(held, np.int64)))
                    held_key, held, spilled = this, [], False
                if b - a == 1 and not held and not spilled:
                    held = [int(fp[a])]
                    continue
                held += fp[a:b].tolist()
                if distance == 2 and (spilled or len(held) > direct):
                    part, spilled, held = np.array(held, np.int64), True, []
                    for i in range(0, len(part), 1024):
                        yield neighbours(part[i : i + 1024])
            if small:
                yield from pa.Table.from_batches(small).combine_chunks().to_batches()
        if len(held) > 1 and not spilled:
            yield compare(np.array(held, np.int64))
        elif spilled and held:
            yield neighbours(np.array(held, np.int64))

    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), distance, blocks)).alias("k")).select("k.choice", "k.bits", "fp")
    runs = keyed.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp")
    return runs.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, hold: Scratch) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): alternating large-star and small-star steps until they rest.

    Each step is a minimum by key, joined back; edges never outnumber those at the start."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = hold.save(e, "edges0")
    turn, last = 0, None
    while True:
        turn += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        new = hold.save(small.filter("u <> v").distinct(), f"edges{turn}")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        hold.drop(f"edges{turn - 1}")
        e = new
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now


def find(docs: DataFrame, distance: int = 2, blocks: int = 4) -> DataFrame:
    """One row per row of `docs`: doc_id, fp (signed 64 bits), component_id."""
    hold = Scratch(docs.sparkSession)
    rows = hold.save(docs.select("doc_id", fingerprint("text").alias("fp")), "fingerprints")
    distinct = hold.save(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "distinct")
    found = hold.save(links(distinct, distance, blocks), "links")
    roots = components(found, hold)
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = hold.save(named.join(ids, "root").select("fp", "rows", "component_id"), "components")
    return join_hot(rows, by_fp, "fp", "rows", rows.count()).select("doc_id", "fp", "component_id")


def drop_linked(docs: DataFrame, distance: int = 2, blocks: int = 4) -> DataFrame:
    """`docs` with exactly one row of each component of rows whose fingerprints link at `distance` or fewer bits: the one of
    the smallest doc_id, null last, of equal ids any one.

    Rows are told apart by a number of their own, so null and repeated ids take no other row with them. Fingerprints
    alone are shuffled; of the rows with their texts only those that a filter takes for dropped ones are."""
    hold = Scratch(docs.sparkSession)
    numbered = docs.select(as_row(docs), F.monotonically_increasing_id().alias("_row"))
    numbered = hold.save(numbered.select("row", "_row", fingerprint("row.text").alias("fp")), "rows")
    rows = numbered.select("_row", "fp", F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), F.col("_row")).alias("order"))
    distinct = hold.save(rows.groupBy("fp").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("rows")), "distinct")
    roots = components(hold.save(links(distinct, distance, blocks), "links"), hold)
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root"))
    stay = named.groupBy("root").agg(F.min("first")["_row"].alias("stay"), F.sum("rows").alias("all")).filter("all > 1")
    by_fp = hold.save(named.join(stay, "root").select("fp", "rows", "stay"), "stay")
    gone = hold.save(join_hot(rows.select("_row", "fp"), by_fp, "fp", "rows", rows.count()).filter("_row <> stay").select("_row"), "gone")
    asked = numbered.withColumn("asked", may_be_in(gone, "_row")("_row"))
    return asked.filter("not asked").unionByName(asked.filter("asked").join(gone, "_row", "left_anti")).select("row.*")


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles; a text without words has the one element 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(1, np.uint64)
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle])) for i in range(n)), np.uint64, n))


def similarity(a: str | None, b: str | None) -> float:
    """Jaccard similarity of two texts' shingle sets."""
    x, y = shingle_set(a), shingle_set(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def band_keys(text: str | None, bands: int = 24, rows: int = 4, seed: int = 11) -> np.ndarray:
    """One key per band from `rows` MinHash values; texts of similarity s agree in no band at (1 - s**rows) ** bands, 3e-6 at 0.8."""
    rng = np.random.default_rng(seed)
    flip, times = (rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    low, x = np.full(bands * rows, np.iinfo(np.uint64).max), shingle_set(text)
    for at in range(0, len(x), 1024):
        low = np.minimum(low, ((x[at : at + 1024, None] ^ flip) * times).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(low[k * rows : (k + 1) * rows].tobytes(), k) for k in range(bands)], np.uint64).view(np.int64)


def link_alike(texts: list[str | None], least: float, ask: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join what is similar among the texts: each unmet text is compared with all that no earlier one reached.

    With `ask`, only the texts marked there are compared, each with all others, and every link is an edge."""
    sets = [shingle_set(t) for t in texts]
    size = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    mark = np.zeros(int(flat.max()) + 1, bool)

    def near(i: int) -> np.ndarray:
        own = flat[starts[i] : starts[i] + size[i]]
        mark[own] = True
        both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[own] = False
        return both / (size + size[i] - both) >= least

    if ask is not None:
        return [(int(i), int(j)) for i in np.flatnonzero(ask) for j in np.flatnonzero(near(i)) if i != j]
    todo, edges = np.ones(len(texts), bool), []
    for root in range(len(texts)):
        front = [root] if todo[root] else []
        todo[root] = False
        while front and todo.any():
            i = front.pop()
            met = np.flatnonzero(near(i) & todo)
            todo[met] = False
            edges += [(i, int(j)) for j in met]
            front += met.tolist()
    return edges


def _in_units(units: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) within units (unit, _row, ask) of bounded size, whose texts meet in one task; `ask` as in `link_alike`,
    null for units to be joined as a whole."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["_row"].to_numpy()
        ask = None if pdf["ask"].isna().any() else pdf["ask"].to_numpy(bool)
        found = np.array(link_alike(pdf["text"].tolist(), least, ask), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": ids[found.min(axis=1)] if len(found) else [], "b": ids[found.max(axis=1)] if len(found) else []})

    return units.join(rows, "_row").groupBy("unit").applyInPandas(link, "a long, b long")


def _by_key(keyed: DataFrame, rows: DataFrame, hold: Scratch, name: str, least: float, direct: int, most: int, bytes_most: int) -> tuple[DataFrame, DataFrame]:
    """Edges among the rows (_row, size, key) that share a key, and the keys of groups too large for one task, with their
    rows `n` and bytes `w`: those are left out."""

    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) >= least for x, y in zip(a, b, strict=True)], dtype=bool)

    groups = hold.save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w")).filter("n > 1"), f"{name}groups")
    small, large = groups.filter(F.col("n") <= direct), groups.filter((F.col("n") > direct) & ((F.col("n") > most) | (F.col("w") > bytes_most)))
    middle = groups.filter((F.col("n") > direct) & (F.col("n") <= most) & (F.col("w") <= bytes_most))
    listed = keyed.join(small.select("key"), "key").groupBy("key").agg(F.sort_array(F.collect_list("_row")).alias("x"))
    pairs = listed.select(F.explode("x").alias("a"), "x").select("a", F.explode(F.filter("x", lambda y: y > F.col("a"))).alias("b"))
    pairs = hold.save(pairs.distinct(), f"{name}pairs")
    left, right = rows.select(F.col("_row").alias("a"), F.col("text").alias("ta")), rows.select(F.col("_row").alias("b"), F.col("text").alias("tb"))
    good = pairs.join(left, "a").join(right, "b").filter(pandas_udf(alike, "boolean")("ta", "tb")).select("a", "b")
    units = keyed.join(middle.select("key"), "key").select(F.col("key").alias("unit"), "_row", F.lit(None).cast("boolean").alias("ask"))
    return good.unionByName(_in_units(units, rows, least)), large


def _huge(members: DataFrame, large: DataFrame, edges: DataFrame, rows: DataFrame, hold: Scratch, least: float, most: int, bytes_most: int) -> DataFrame:
    """Edges within the groups `large` of `members` (_row, size, key), however large.

    A group is dealt into pieces, each joined in a task of its own. What then still lies outside the group's largest
    component is compared, piece by piece, with the whole group. So no link is lost, and a group costs its rows
    times its pieces of strays, which is once where all but a few are copies of one another."""
    deal = lambda n, w: F.greatest(F.ceil(F.col(n) / F.lit(most)), F.ceil(F.col(w) / F.lit(bytes_most))).cast("long")
    place = lambda of: F.pmod(F.xxhash64("key", "_row"), F.col(of))
    whole = join_hot(members, large.withColumn("pieces", deal("n", "w")), "key", "n", members.count())
    whole = hold.save(whole.select("key", "_row", "size", "n", "pieces", place("pieces").alias("piece")), "huge")
    parts = whole.select(F.xxhash64("key", "piece").alias("unit"), "_row", F.lit(None).cast("boolean").alias("ask"))
    edges = hold.save(edges.unionByName(_in_units(parts, rows, least)), "parted")
    below = hold.save(components(edges, hold), "parts")
    rooted = whole.join(below.withColumnRenamed("node", "_row"), "_row", "left").withColumn("root", F.coalesce("root", "_row"))
    rooted = hold.save(rooted, "rooted")
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("w"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("n"), F.max("c").alias("c"), F.sum("w").alias("all"), F.max_by("w", F.struct("c", "root")).alias("w"))
    main = main.filter("c < n").select("key", "main", F.col("n").alias("rows"), (F.col("n") - F.col("c")).alias("strays"), (F.col("all") - F.col("w")).alias("stray_bytes"))
    main = hold.save(main.withColumn("turns", deal("strays", "stray_bytes")), "strays")
    if main.isEmpty():
        return edges
    met = hold.save(join_hot(rooted, main, "key", "rows", rooted.count()), "met")
    turn = F.pmod(F.xxhash64("_row", "key"), F.col("turns"))
    unit = F.xxhash64("key", "turn", "piece").alias("unit")
    asking = met.filter("root <> main").select("key", "_row", turn.alias("turn"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(True).alias("ask"))
    asked = met.select("key", "_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), "piece", F.lit(False).alias("ask"))
    units = asking.unionByName(asked).groupBy(unit, "_row").agg(F.max("ask").alias("ask"))
    return edges.unionByName(_in_units(units, rows, least))


def similar_pairs(rows: DataFrame, hold: Scratch, least: float = 0.8, direct: int = 32, most: int = 2048, bytes_most: int = 1 << 23) -> DataFrame:
    """Edges (a, b) between rows (_row, text) whose shingle sets have a similarity of `least`, enough to join all that link.

    A group is the rows that share a band's key. Up to `direct` rows are compared pair by pair, larger groups in one task,
    where a row that has been reached is not compared again. Rows of groups beyond `most` rows or `bytes_most` bytes are
    keyed anew by 64 bands of eight values, by which texts of similarity 0.8 meet but for a chance of 8e-6 and others seldom;
    groups that are still too large are dealt over tasks (`_huge`)."""

    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([band_keys(t) for t in texts])

    def fine_keys(texts: pd.Series) -> pd.Series:
        return pd.Series([band_keys(t, bands=64, rows=8, seed=29) for t in texts])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")
    keyed = hold.save(rows.select("_row", size, F.explode(pandas_udf(keys, "array<long>")("text")).alias("key")), "keys")
    edges, large = _by_key(keyed, rows, hold, "", least, direct, most, bytes_most)
    edges = hold.save(edges, "edges")
    if large.isEmpty():
        return edges
    again = join_hot(keyed.select("_row", "key"), large.select("key", "n"), "key", "n", keyed.count()).select("_row").distinct()
    fine = again.join(rows, "_row").select("_row", size, F.explode(pandas_udf(fine_keys, "array<long>")("text")).alias("key"))
    fine = hold.save(fine, "finekeys")
    more, huge = _by_key(fine, rows, hold, "fine", least, direct, most, bytes_most)
    edges = hold.save(edges.unionByName(more), "fineedges")
    return edges if huge.isEmpty() else hold.save(_huge(fine, huge, edges, rows, hold, least, most, bytes_most), "similar")


def drop_near_copies(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """`docs` with exactly one row of each component of rows with five-word shingle similarity >= `least`: the one of
    the smallest doc_id, null last, of equal ids any one.

    Rows are told apart by a number of their own, so null and repeated ids take no other row with them. SimHash bits do
    not serve here: at a similarity of 0.8 they differ in about 10 of 64, and blocks for that distance are a few bits wide."""
    hold = Scratch(docs.sparkSession)
    rows = hold.save(docs.select(as_row(docs), F.monotonically_increasing_id().alias("_row")), "rows")
    below = hold.save(components(similar_pairs(rows.select("_row", F.col("row.text").alias("text")), hold, least), hold), "below")
    roots = below.unionByName(below.select(F.col("root").alias("node"), "root").distinct())
    ids = roots.join(rows.select(F.col("_row").alias("node"), F.col("row.doc_id").alias("doc_id")), "node")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node"))
    stay = ids.groupBy("root").agg(F.min(order)["node"].alias("node"))
    gone = hold.save(roots.join(stay, "node", "left_anti").select(F.col("node").alias("_row")), "gone")
    return rows.join(gone, "_row", "left_anti").select("row.*")
