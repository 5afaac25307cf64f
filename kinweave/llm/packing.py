"""Best-fit packing of whole documents into sequences, by bin completion on the histogram of lengths.

Pieces are token ids of a document and an end id; only documents longer than a sequence are cut, the first
piece being the shorter one. There are at most `capacity` lengths, so the search for fillings runs on a
histogram of fixed size, for any number of documents; pieces are then dealt to the fillings by their rank
within their length.

A null or empty text is the end id alone. Repeated rows are pieces of their own. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, few_rows

#: Characters for which both libraries split a text alike; other texts go through `tokenizers` itself.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ]*")
_LOADED: dict[str, tuple] = {}


class Encoder:
    """Token ids by the public byte-level BPE vocabulary `name`.

    `tokenizers` defines the ids. Where a text has only PLAIN characters and no special token, the same
    vocabulary as ranks gives the same ids about five times faster; tests hold the two against each other."""

    def __init__(self, name: str):
        self.name = name

    def _load(self) -> tuple:
        if self.name not in _LOADED:
            import base64
            import os

            import public_tokenizers
            import tiktoken
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(public_tokenizers.path(self.name))
            fast, ranks = None, public_tokenizers.path(re.sub(r"\.json$", ".tiktoken", self.name))
            if os.path.exists(ranks):
                with open(ranks, "rb") as f:
                    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
                fast = tiktoken.Encoding(self.name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            special = [t.content for t in slow.get_added_tokens_decoder().values()]
            _LOADED[self.name] = slow, fast, special
        return _LOADED[self.name]

    def encode(self, text: str | None) -> list[int]:
        slow, fast, special = self._load()
        text = text or ""
        if fast and PLAIN.fullmatch(text) and not any(s in text for s in special):
            return fast.encode_ordinary(text)
        return slow.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of the ids as little-endian 32-bit), and the ids if asked."""
    encoder = Encoder(tokenizer)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def cut(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at, rows, size = [], [], 0
            for i in range(len(texts)):
                tokens = np.array([*encoder.encode(texts[i].as_py()), end_id], "<u4")
                first = (len(tokens) - 1) % capacity + 1
                for k, stop in enumerate(range(first, len(tokens) + 1, capacity)):
                    start = max(0, stop - capacity) if k else 0
                    part = tokens[start:stop]
                    at.append(i)
                    rows.append((k, start, len(part), zlib.crc32(part.tobytes()), *([part.view(np.int32)] if with_ids else [])))
                    size += len(part)
                if size > 1 << 20 or (i + 1 == len(texts) and rows):
                    cols = list(zip(*rows, strict=True))
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=schema.names)
                    at, rows, size = [], [], 0

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class _Counts:
    """A multiset of lengths with the largest at most x at hand."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v}
        self.keys = sorted(self.n)

    def at_most(self, x: int, used: tuple[int, ...]) -> int:
        """Largest length up to x with more copies than are in `used`; 0 if there is none."""
        i = bisect.bisect_right(self.keys, x) - 1
        while i >= 0 and self.n[self.keys[i]] <= used.count(self.keys[i]):
            i -= 1
        return self.keys[i] if i >= 0 else 0

    def take(self, lengths: dict[int, int], times: int) -> None:
        for k, c in lengths.items():
            self.n[k] -= c * times
            if not self.n[k]:
                del self.n[k]
                self.keys.pop(bisect.bisect_left(self.keys, k))


def _best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best fit decreasing, a filling (lengths, the largest first) at a time: the incumbent."""
    left, out = _Counts(counts), Counter()
    while left.keys:
        room, chosen = capacity, ()
        while fit := left.at_most(room, chosen):
            chosen, room = (*chosen, fit), room - fit
        used = Counter(chosen)
        times = min(left.n[k] // c for k, c in used.items())
        left.take(used, times)
        out[chosen] += times
    return out


def _completions(left: _Counts, largest: int, capacity: int, allowed: int, nodes: int, enough: int) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of a bin around `largest` that waste `allowed` at most, as (waste, lengths), least waste first.

    Depth first, large lengths first, `nodes` steps at most, up to `enough` fillings without waste. A filling is dominated if a length in it can be
    exchanged for a larger one that also fits, so each leaf takes the largest length that fits at its end."""
    found: list[tuple[int, tuple[int, ...]]] = []
    stack = [(capacity - largest, largest, (largest,))]
    while stack and nodes:
        room, top, chosen = stack.pop()
        nodes -= 1
        fit = left.at_most(min(room, top), chosen)
        if not fit:
            if room <= allowed:
                found.append((room, chosen))
                enough -= not room
                if not enough:
                    break
            continue
        if lower := left.at_most(fit - 1, chosen):
            stack.append((room, lower, chosen))
        stack.append((room - fit, fit, (*chosen, fit)))
    return sorted(found, key=lambda f: f[0])


def _descend(counts: dict[int, int], capacity: int, allowed: int, nodes: int, slack: int, middle: bool = False) -> tuple[Counter, Counter, int]:
    """(fillings, lengths left over, waste still allowed): always completes a bin of the largest length, never goes back.

    Of the fillings with least waste it takes the first, which has the larger lengths, or the one in the `middle`.
    A length that no filling within the allowance holds is left over. `slack` limits how much of the stock one filling uses."""
    left, out, rest = _Counts(counts), Counter(), Counter()
    while left.keys:
        largest = left.keys[-1]
        found = _completions(left, largest, capacity, allowed, nodes, 16 if middle else 1)
        if not found:
            rest[largest] = left.n[largest]
            left.take({largest: rest[largest]}, 1)
            continue
        ties = [f for f in found if f[0] == found[0][0]]
        room, chosen = ties[len(ties) // 2 if middle else 0]
        used = Counter(chosen)
        times = max(1, min(left.n[k] // c for k, c in used.items()) // slack)
        times = min(times, allowed // room) if room else times
        left.take(used, times)
        allowed -= room * times
        out[chosen] += times
    return out, rest, allowed


def _all_fillings(items: dict[int, int], capacity: int, allowed: int, most: int) -> list[tuple[int, tuple[int, ...]]]:
    """The fillings of `items` that waste `allowed` at most, as (waste, lengths).

    A branch ends where no subset of the items brings its waste under the bound. All are listed while they are fewer
    than `most`, after 50 steps for each; else each length, as the largest of its filling, has its share of them."""
    keys, out = sorted(items, reverse=True), []
    sums = 1  # bit x: some items add up to x
    for k in keys:
        for _ in range(min(items[k], capacity // k)):
            sums |= sums << k

    def reachable(room: int) -> int:
        least = max(0, room - allowed)
        return (sums >> least) & ((1 << (room - least + 1)) - 1)

    for first, top in enumerate(keys):
        stack, share = [(capacity - top, first, items[top] - 1, (top,))], len(out) + (most - len(out)) // (len(keys) - first)
        steps = 50 * most // len(keys)
        while stack and steps > 0 and len(out) < share:
            room, i, copies, chosen = stack.pop()
            if room <= allowed:
                out.append((room, chosen))
            for j in range(len(keys) - 1, i - 1, -1) if room >= keys[-1] else ():
                k, steps = keys[j], steps - 1
                if k > room:
                    break
                if (j > i or copies) and reachable(room - k):
                    stack.append((room - k, j, (copies if j == i else items[k]) - 1, (*chosen, k)))
    return out


def _branch(items: Counter, rows: list, allowed: int, rng: np.random.Generator, nodes: int) -> list[tuple[int, ...]]:
    """Of the fillings `rows` those whose waste adds up to `allowed` at most: all of `items` if the search finds that, else as much as it found.

    Depth first with backtracking. It branches over the fillings around the length that has the fewest, least waste
    first, and turns back where some length has none left within the waste that remains. `nodes` bounds the branchings."""
    if not rows:
        return []
    lengths = sorted(items)
    place = {k: i for i, k in enumerate(lengths)}
    need = np.zeros((len(rows), len(lengths)), np.int16)
    for r, (_, chosen) in enumerate(rows):
        for k in chosen:
            need[r, place[k]] += 1
    waste, holds = np.array([w for w, _ in rows]), need > 0

    def around(left: np.ndarray, spare: int) -> tuple[list[int], bool]:
        """The fillings of the length with the fewest of them, in random order but for the waste, and whether a length has none."""
        open_ = np.flatnonzero((need <= left).all(axis=1) & (waste <= spare))
        ways = holds[open_].sum(axis=0)
        wanted = left > 0
        if not (wanted & (ways > 0)).any():
            return [], bool(wanted.any())
        least = int(np.where(wanted & (ways > 0), ways, len(rows) + 1).argmin())
        choice = open_[holds[open_, least]]
        order = np.lexsort((rng.random(len(choice)), waste[choice]))
        return choice[order].tolist(), bool((wanted & (ways == 0)).any())

    left, spare, now, best = np.array([items[k] for k in lengths], np.int16), allowed, [], []
    levels = [iter(around(left, spare)[0])]
    while levels and nodes:
        if len(now) == len(levels):  # the choice at this level led nowhere
            r = now.pop()
            spare += waste[r]
            left += need[r]
        r = next((r for r in levels[-1] if waste[r] <= spare and (need[r] <= left).all()), None)
        if r is None:
            levels.pop()
            continue
        nodes -= 1
        now.append(r)
        spare -= waste[r]
        left -= need[r]
        if not left.any():
            return [rows[x][1] for x in now]
        further, none = around(left, spare)
        if not none and nodes:
            levels.append(iter(further))
        elif len(now) > len(best) or not nodes:
            # as far as this branch goes without the lengths that have no filling
            trial, rest, on = left.copy(), spare, list(now)
            while further:
                on.append(further[0])
                rest -= waste[further[0]]
                trial -= need[further[0]]
                further = around(trial, rest)[0]
            best = max(best, on, key=len)
    return [rows[x][1] for x in best]


def _search(counts: dict[int, int], capacity: int, target: int, nodes: int, tries: int, bins: int, seed: int = 0, most: int = 3000) -> Counter | None:
    """Fillings of all lengths in `target` bins, or None if it finds none.

    One descent, then branch and bound on parts: what is left over and as many bins as make `bins` are emptied
    and packed anew by `_branch`. With no more than `bins` in all, the part is the whole. Waste beyond the target's never occurs, so a search that leaves nothing over
    has reached the target."""
    allowed = target * capacity - sum(k * v for k, v in counts.items())
    plan, rest, allowed = _descend(counts, capacity, allowed, nodes, 1, middle=True)
    rng, shuffle = random.Random(seed), np.random.default_rng(seed)
    stale = 0
    for _ in range(tries):
        if not any(rest.values()) or stale >= 30:
            break
        stale += 1
        over = [k for k, v in rest.items() for _ in range(min(v, 8 * bins))]
        rng.shuffle(over)
        over = over[: 2 * bins]
        kinds = list(plan)
        emptied = Counter(rng.sample(kinds, min(len(kinds), max(1 + bins // 4, bins - -(-sum(over) // capacity)))))
        if sum(plan.values()) <= bins:
            emptied = plan.copy()
        items = Counter(over)
        for chosen, times in emptied.items():
            for k in chosen:
                items[k] += times
        before = sum(sum(chosen) * times for chosen, times in emptied.items())
        spare = allowed + sum((capacity - sum(chosen)) * times for chosen, times in emptied.items())
        rows = _all_fillings(items, capacity, spare, most)
        found = _branch(items, rows, spare, shuffle, min(nodes, 1 + 200_000 // max(1, len(rows))))
        if not found or sum(map(sum, found)) < before:
            continue
        if sum(map(sum, found)) > before:
            stale = 0
        plan = plan - emptied + Counter(found)
        rest = rest - Counter(over) + (items - Counter(k for chosen in found for k in chosen))
        allowed = spare - sum(capacity - sum(chosen) for chosen in found)
    return None if any(rest.values()) else plan


def fillings(counts: dict[int, int], capacity: int = 2048, nodes: int = 1000, tries: int = 120, bins: int = 30) -> list[tuple[dict[int, int], int]]:
    """Bin completion: fillings (length -> copies) and how often each is used, in as few bins as found.

    Best fit decreasing is the incumbent; total/capacity, and the lengths over half of it, bound the bins from below.
    Descents that complete the bin of the largest length improve the incumbent, each within the waste of one bin less.
    Where the bound is not met, `_search` tries the bound itself, then numbers between it and the incumbent.
    The budget: `nodes` branchings for each of `tries` parts of about `bins` bins for the bound, an eighth of the parts for
    each of the others (fewer numbers than the logarithm of the gap); thirty parts without progress end a search."""
    counts = {k: v for k, v in counts.items() if v}
    total = sum(k * v for k, v in counts.items())
    bound = max(-(-total // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))
    best = _best_fit(counts, capacity)
    for slack in (1, 2, 4):
        size = sum(best.values())
        if size <= bound:
            break
        plan, rest, _ = _descend(counts, capacity, (size - 1) * capacity - total, nodes // 4, slack)
        best = best if rest else plan
    low = bound
    while low < (size := sum(best.values())):
        target = bound if low == bound else (low + size - 1) // 2
        plan = _search(counts, capacity, target, nodes, tries if target == bound else tries // 8, bins)
        if plan:
            best = plan
        low = target if plan else target + 1
    return [(dict(Counter(chosen)), times) for chosen, times in best.items()]


def _salts(n: int, few: int = 1000, many: int = 500_000) -> int:
    """Groups in which a length of n pieces is ranked: of `few` rows up to 64 of them, of `many` rows beyond."""
    return max(min(64, -(-n // few)), -(-n // many))


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """`parts` (any rows with doc_id, piece, length) with sequence_id and offset.

    A hot length is ranked in independent groups whose sizes are summed first: the driver gets 64*capacity
    counts and one for each half a million pieces. The plan sent back has a few slots per filling."""
    spark = parts.sparkSession
    salts = {r["length"]: _salts(r["count"]) for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    named = few_rows(spark, list(salts.items()), "length long, _salts int")
    keyed = parts.join(F.broadcast(named), "length").select(*parts.columns, F.pmod(F.xxhash64("doc_id", "piece"), "_salts").cast("int").alias("_salt"))
    sizes = keyed.groupBy("length", "_salt").count().collect()
    by_length: dict[int, dict[int, int]] = defaultdict(dict)
    for r in sizes:
        by_length[r["length"]][r["_salt"]] = r["count"]
    plan = fillings({k: sum(v.values()) for k, v in by_length.items()}, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by length: first rank, first sequence, offset
    dealt: dict[int, int] = defaultdict(int)
    sequence = 0
    for need, times in plan:
        offset = 0
        for length in sorted(need, reverse=True):
            for _ in range(need[length]):
                slots[length].append((dealt[length], sequence, offset))
                dealt[length] += times
                offset += length
        sequence += times
    rows = []
    for length, salted in by_length.items():
        base, bounds = 0, []
        for salt in range(salts[length]):
            bounds.append(base)
            base += salted.get(salt, 0)
        rows.append((length, bounds, *map(list, zip(*slots[length], strict=True))))
    # at most `capacity` rows
    side = few_rows(spark, rows, "length long, _bases array<long>, _ranks array<long>, _seqs array<long>, _offs array<int>")
    turn = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", *(["ids_crc32"] if "ids_crc32" in parts.columns else [])))
    ranked = keyed.withColumn("_turn", turn - 1).join(F.broadcast(side), "length")
    ranked = ranked.withColumn("_rank", F.col("_turn") + F.element_at("_bases", F.col("_salt") + 1))
    # slots are sorted by first rank: halve the range until one is left
    find = "aggregate(sequence(1, 40), named_struct('lo', 0, 'hi', size(_ranks)), (s, i) -> if(s.hi - s.lo <= 1, s, if(_ranks[(s.lo + s.hi) div 2] <= _rank, named_struct('lo', cast((s.lo + s.hi) div 2 as int), 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)))), s -> s.lo)"
    ranked = ranked.withColumn("_slot", F.expr(find))
    out = ranked.withColumn("sequence_id", F.expr("_seqs[_slot] + _rank - _ranks[_slot]")).withColumn("offset", F.expr("cast(_offs[_slot] as long)"))
    return out.select(*parts.columns, "sequence_id", "offset")


def packed(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of `docs` with their place; tokenised once, then held in the shared folder."""
    parts = Scratch(docs.sparkSession).save(pieces(docs, tokenizer, capacity, with_ids=with_ids), "pieces")
    return pack(parts, capacity)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """The packed token ids: sequence_id and ids, from pieces that carry their ids."""
    parts = packed_pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x.ids)).alias("ids"))
