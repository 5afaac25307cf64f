"""Language-model scores: a gated recurrent unit with a class-factored softmax over counted words.

Texts are lower-cased in A-Z and cut into words at `[\\x20\\x09-\\x0D]`, with an end token each; a null or empty
text is the end token alone. Counts, vocabulary and totals are exact over all training documents.

The output is factored: a class, then a word in it. Every word has a class, and the network learns the class of
each. The most frequent words (`HEAD` times the root of the number of different words) are cut by frequency
into classes with a softmax each; all others fall into classes by the power of two of their count, within which
a word has its count's share, plus one. Words never seen count as one more word of the lowest class, so the
probabilities of the known words and the unknown one add up to 1, as they do for the base score.

Gradients come from every training document, once. Documents are laid end to end in the order of their ids; a
task reads a run of them in lanes and starts afresh at each document. A lane's first document may begin within.

Repeated rows get equal scores. An empty table gives an empty result; with no training document every word is
unknown. A very long text is one row of its chunk, held whole; its state is carried to its end. A null doc_id is
kept and scored. A word is known by its 64-bit hash.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .simhash import LOWER

END = xxhash.xxh64_intdigest(b"\n") - (1 << 63)
CLASS = 64
HEAD = 2
#: A chunk is closed at so many different words or tokens: what a task holds, for any input.
CHUNK_WORDS, CHUNK_TOKENS = 350_000, 2_500_000
#: Documents of about so many tokens are scored together.
SCORE_TOKENS = 4_000_000


def _with(id_type: T.DataType, fields: str) -> T.StructType:
    return T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string(fields).fields])


def _chunks(docs: DataFrame) -> DataFrame:
    """Documents as numbers of their chunk's words, and one row per chunk with its words' hashes and training counts."""

    def encode(batches):
        part, turn, names = TaskContext.get().partitionId(), 0, ["doc_id", "chunk", "held", "ids", "words", "counts"]
        vocab, rows, tokens = {}, [], 0

        def start():
            nonlocal vocab, rows, tokens, turn
            vocab, rows, tokens, turn = _Numbers(), [], 0, turn + 1

        def close():
            chunk = (part << 24) + turn
            taught = [x for _, held, x in rows if not held] or [np.zeros(0, np.int32)]
            total = np.bincount(np.concatenate(taught), minlength=len(vocab))
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) - (1 << 63) for w in vocab), np.int64, len(vocab))
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), pa.array([chunk] * n), pa.array([r[1] for r in rows]), pa.array([r[2].tobytes() for r in rows], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.array([chunk]), pa.array([False]), pa.nulls(1, pa.binary()), pa.array([hashes.tobytes()]), pa.array([total.tobytes()])], names=names)

        id_type = None
        start()
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "replace").translate(LOWER).split()
                words.append(b"\n")
                x = np.fromiter(map(vocab.__getitem__, words), np.int32, len(words))
                rows.append((doc_id, bool(held), x))
                tokens += len(words)
                if len(vocab) >= CHUNK_WORDS or tokens >= CHUNK_TOKENS:
                    yield from close()
                    start()
        if rows:
            yield from close()

    kind = _with(docs.schema["doc_id"].dataType, "chunk long, held boolean, ids binary, words binary, counts binary")
    return docs.select("doc_id", "held_out", "text").mapInArrow(encode, kind)


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _spread(chunks: DataFrame) -> DataFrame:
    """(word, chunk, place, n): a row per word of each chunk."""

    def rows(batches):
        for batch in batches:
            for chunk, words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                w, n = np.frombuffer(words, np.int64), np.frombuffer(counts, np.int64)
                for a in range(0, len(w), 100_000):
                    b = min(len(w), a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(w[a:b]), pa.array(np.full(b - a, chunk)), pa.array(np.arange(a, b, dtype=np.int32)), pa.array(n[a:b])], names=["word", "chunk", "place", "n"])

    return chunks.filter("words is not null").select("chunk", "words", "counts").mapInArrow(rows, "word long, chunk long, place int, n long")


class Words:
    """What every task knows of the counts: totals, the most frequent words, and the weight of each class of the others."""

    def __init__(self, counts: DataFrame, shortlist: int | None = None):
        band = F.floor(F.log2(F.greatest(F.col("c"), F.lit(1)))).cast("int")
        seen = counts.filter("c > 0")
        stats = seen.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()  # at most 64 rows
        self.kinds, self.tokens = sum(r["v"] for r in stats), sum(r["n"] for r in stats)
        most = shortlist or int(np.ceil(HEAD * np.sqrt(self.kinds)))
        top = seen.orderBy(F.desc("c"), "word").limit(most).collect()
        self.least = top[-1]["c"] if top else 1
        self.head = len(top)
        self.head_classes = -(-self.head // CLASS)
        self.bands = max([r["band"] for r in stats], default=0) + 1
        kinds, tokens = np.zeros(self.bands), np.zeros(self.bands)
        for r in stats:
            kinds[r["band"]], tokens[r["band"]] = r["v"], r["n"]
        hashes, self.freq = np.array([r["word"] for r in top], np.int64), np.array([r["c"] for r in top], float)
        for r in top:
            b = int(r["c"]).bit_length() - 1
            kinds[b] -= 1
            tokens[b] -= r["c"]
        weight = kinds + tokens
        weight[0] += 1  # the unknown word
        self.band_weight = np.maximum(weight, 1.0)
        heads = np.add.reduceat(self.freq, np.arange(0, self.head, CLASS)) if self.head else np.zeros(0)
        self.class_freq = np.concatenate([heads, np.maximum(tokens, 0) + 1])
        self.at = np.argsort(hashes)
        self.sorted = hashes[self.at]
        self.end = int(np.flatnonzero(hashes == END)[0]) if END in hashes else self.head
        self.kind = np.uint16 if self.head + self.bands < 1 << 16 else np.uint32

    def code(self, word: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(model number, log10 share within the class, 0 for the most frequent words) of words with counts; word may be 0 where c is below the frequent words' least."""
        band = np.floor(np.log2(np.maximum(c, 1))).astype(np.int64)
        number = self.head + band
        rare = np.log10((c + 1) / self.band_weight[band])
        if self.head:
            at = np.minimum(np.searchsorted(self.sorted, word), self.head - 1)
            top = (self.sorted[at] == word) & (c >= self.least)
            number[top], rare[top] = self.at[at[top]], 0.0
        return number.astype(self.kind), rare


def _coded(chunks: DataFrame, counted: DataFrame, words: Words) -> DataFrame:
    """Each document as the model's numbers, with what the counts alone decide."""
    sc = chunks.sparkSession.sparkContext
    held = sc.broadcast(words)  # grows with the root of the vocabulary: 240 kB for 100 million words

    def code(docs: pa.Table, seen: pa.Table) -> pa.Table:
        place, c = seen["place"].to_numpy(), seen["c"].to_numpy()
        number, rare = held.value.code(seen["top"].to_numpy(), c)
        n = len(place)
        by_place = lambda x: _put(np.zeros(n, x.dtype), place, x)
        number, rare, logs, known = by_place(number), by_place(rare), by_place(np.log10(c + 1.0)), by_place((c > 0).astype(np.int64))
        out = []
        docs = docs.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        for raw in docs["ids"]:
            x = np.frombuffer(raw.as_buffer(), np.int32)
            out.append((len(x), int(known[x].sum()), float(logs[x].sum()), float(rare[x].sum()), number[x].tobytes()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        return pa.table([docs["doc_id"], docs["held"], *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], names=["doc_id", "held", "n_tokens", "n_known", "logs", "rare", "numbers"])

    kind = _with(chunks.schema["doc_id"].dataType, "held boolean, n_tokens long, n_known long, logs double, rare double, numbers binary")
    docs = chunks.filter("ids is not null").select("doc_id", "chunk", "held", "ids")
    return docs.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(code, kind)


def _put(to: np.ndarray, at: np.ndarray, what: np.ndarray) -> np.ndarray:
    to[at] = what
    return to


def _exp_sum(e: np.ndarray) -> np.ndarray:
    """Exponentials in place, and their sum by row; Rates keeps them in range."""
    np.exp(e, out=e)
    return e @ np.ones(e.shape[1], np.float32)


class Gru:
    """The network. Parameters: x (a row per input word: its gates' inputs), u, wc, bc (classes), ww, bw (shortlist)."""

    NAMES = ("x", "u", "wc", "bc", "ww", "bw")

    def __init__(self, words: Words, width: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        inputs, classes = words.head + words.bands, words.head_classes + words.bands
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.head, self.head_classes, self.end, self.width = words.head, words.head_classes, words.end, width
        self.classes = classes
        full = words.head_classes * CLASS
        self.x, self.u, self.wc, self.ww = draw(inputs, 3 * width), draw(width, 3 * width), draw(width, classes), draw(full, width)
        self.bc = np.log(words.class_freq / words.class_freq.sum()).astype(np.float32)
        self.bw = np.full(full, -30, np.float32)
        within = words.freq / np.repeat(words.class_freq[: words.head_classes], CLASS)[: words.head]
        self.bw[: words.head] = np.log(within)

    def get(self) -> bytes:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).tobytes()

    def put(self, raw: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            a = getattr(self, n)
            setattr(self, n, raw[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size

    def step(self, x: np.ndarray, h: np.ndarray):
        """The next state from the inputs' rows `x` and the last state, and what its gradient needs."""
        k = self.width
        g = h @ self.u
        gates = x[:, : 2 * k] + g[:, : 2 * k]
        gates *= np.float32(0.5)
        np.tanh(gates, out=gates)
        gates += np.float32(1)
        gates *= np.float32(0.5)  # the logistic function
        z, r = gates[:, :k], gates[:, k:]
        n = r * g[:, 2 * k :]
        n += x[:, 2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, g

    def class_of(self, y: np.ndarray) -> np.ndarray:
        return np.where(y < self.head, y // CLASS, y.astype(np.int64) - self.head + self.head_classes)

    def outputs(self, hs: np.ndarray, y: np.ndarray, learn: bool = False, slab: int = 1024):
        """Natural log probability of class and word for each row; with learn also the gradients of its negative sum.

        Rows are taken in the order of their classes: a slab at a time for the class, a class at a time for the word."""
        c = self.class_of(y)
        order = np.argsort(c.astype(np.uint16) if self.classes < 1 << 16 else c, kind="stable")
        c, y, n, k = c[order], y[order].astype(np.int64), len(y), self.width
        one = np.ones((n, k + 1), np.float32)  # the last column carries the biases
        one[:, :k] = hs[order]
        lp, dh = np.empty(n, np.float32), np.empty((n, k), np.float32) if learn else None
        w = np.vstack([self.wc, self.bc])
        dw, dv = np.zeros_like(w), np.zeros((len(self.ww), k + 1), np.float32) if learn else None
        back = np.ascontiguousarray(self.wc.T)
        for a in range(0, n, slab):
            part, col = one[a : a + slab], c[a : a + slab]
            at = np.arange(len(col))
            e = part @ w
            lp[a : a + slab] = e[at, col]
            s = _exp_sum(e)
            lp[a : a + slab] -= np.log(s)
            if learn:
                e *= (1 / s)[:, None]
                e[at, col] -= 1
                dw += part.T @ e
                np.matmul(e, back, out=dh[a : a + slab])
        ends = np.searchsorted(c, np.arange(self.head_classes + 1))
        for j in np.flatnonzero(np.diff(ends)):
            i, span = slice(ends[j], ends[j + 1]), slice(j * CLASS, (j + 1) * CLASS)
            part, col, v = one[i], y[i] - j * CLASS, np.column_stack([self.ww[span], self.bw[span]])
            at = np.arange(len(col))
            e = part @ v.T
            right = e[at, col]
            s = _exp_sum(e)
            lp[i] += right - np.log(s)
            if learn:
                e *= (1 / s)[:, None]
                e[at, col] -= 1
                dv[span] = e.T @ part
                dh[i] += e @ v[:, :k]
        out = np.empty(n, np.float32)
        out[order] = lp
        if not learn:
            return out
        back = np.empty_like(dh)
        back[order] = dh
        return out, back, {"wc": dw[:k], "bc": dw[k], "ww": dv[:, :k], "bw": dv[:, k]}

    def score(self, docs: list[np.ndarray], window: int = 32, slab: int = 1 << 13) -> np.ndarray:
        """Log10 probability of each whole document; all documents go on together, their states carried from window to window."""
        if not docs:
            return np.zeros(0)
        size = np.array([len(d) for d in docs])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        flat = np.concatenate([docs[i] for i in order])
        starts = np.cumsum(size) - size
        before = np.roll(flat, 1)
        before[starts[size > 0]] = self.end
        total, h = np.zeros(len(docs)), np.zeros((len(docs), self.width), np.float32)
        for t0 in range(0, int(size[0]), window):
            live = int(np.searchsorted(-size, -t0, side="left"))
            h = h[:live]
            states, targets, lanes = [], [], []
            for t in range(t0, min(t0 + window, int(size[0]))):
                on = int(np.searchsorted(-size, -t, side="left"))
                at = starts[:on] + t
                new = self.step(self.x[before[at]], h[:on])[0]
                h = new if on == len(h) else np.concatenate([new, h[on:]])
                states.append(new)
                targets.append(flat[at])
                lanes.append(np.arange(on))
                if sum(map(len, lanes)) >= slab or t + 1 == min(t0 + window, int(size[0])):
                    lp = self.outputs(np.concatenate(states), np.concatenate(targets).astype(np.int64))
                    total[:live] += np.bincount(np.concatenate(lanes), weights=lp, minlength=live)
                    states, targets, lanes = [], [], []
        out = np.zeros(len(docs))
        out[order] = total / np.log(10)
        return out

    def window(self, h: np.ndarray, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, on: np.ndarray):
        """(loss, gradients, last state) of one window; all arrays are (time, lane).

        The gradient of `x` is (rows, sums): a sum for each input word that occurs. A lane starts from nothing where `fresh`."""
        k, (steps, lanes) = self.width, x.shape
        trace, hs, rows = [], np.empty((steps, lanes, k), np.float32), self.x[x]
        goes = (~fresh).astype(np.float32)[:, :, None]
        for t in range(steps):
            h0 = h * goes[t]
            h, z, r, n, g = self.step(rows[t], h0)
            trace.append((h0, z, r, n, g))
            hs[t] = h
        dall = np.zeros((steps * lanes, k), np.float32)
        mask = on.ravel()
        lp, dall[mask], grads = self.outputs(hs.reshape(-1, k)[mask], y.ravel()[mask], learn=True)
        dall = dall.reshape(steps, lanes, k)
        dx, dgs = np.empty((steps, lanes, 3 * k), np.float32), np.empty((steps, lanes, 3 * k), np.float32)
        carry, back = np.zeros((lanes, k), np.float32), np.ascontiguousarray(self.u.T)
        for t in range(steps - 1, -1, -1):
            h0, z, r, n, g = trace[t]
            dh, rest = dall[t] + carry, 1 - z
            dn = dh * rest
            dn *= 1 - n * n
            dx[t, :, :k] = dh * (h0 - n) * z * rest
            dx[t, :, k : 2 * k] = dn * g[:, 2 * k :] * r * (1 - r)
            dx[t, :, 2 * k :] = dn
            dgs[t] = dx[t]
            dgs[t, :, 2 * k :] *= r
            carry = dh * z
            carry += dgs[t] @ back
            carry *= goes[t]
        grads["u"] = np.stack([old[0] for old in trace]).reshape(-1, k).T @ dgs.reshape(-1, 3 * k)
        order = np.argsort(x.ravel(), kind="stable")
        words = x.ravel()[order]
        starts = np.flatnonzero(np.diff(words, prepend=-1))
        grads["x"] = words[starts], np.add.reduceat(dx.reshape(-1, 3 * k)[order], starts, axis=0)
        return -float(lp.sum()), grads, h

    def train(self, docs: list[np.ndarray], lanes: int = 512, steps: int = 16, rate: float = 0.01, rates: Rates | None = None) -> int:
        """Truncated backpropagation over all of `docs`, laid end to end and cut into lanes of equal length; returns the tokens read."""
        docs = [d for d in docs if len(d)]
        if not docs:
            return 0
        rates = rates or Rates(self)
        flat = np.concatenate(docs).astype(np.int64)
        fresh = np.zeros(len(flat), bool)
        fresh[np.cumsum([0, *map(len, docs[:-1])])] = True
        before = np.where(fresh, self.end, np.roll(flat, 1))
        lanes = max(1, min(lanes, len(flat) // steps))
        length = -(-len(flat) // lanes)
        starts, h = np.arange(lanes) * length, np.zeros((lanes, self.width), np.float32)
        for t in range(0, length, steps):
            at = np.arange(t, min(t + steps, length))[:, None] + starts
            on = at < len(flat)
            at = np.minimum(at, len(flat) - 1)
            _, grads, h = self.window(h, before[at], flat[at], fresh[at], on)
            rates.apply(self, grads, max(1, int(on.sum())), rate)
        return len(flat)


class Rates:
    """Step sizes from past gradients: Adam for what every window touches, sums of squares for the input words."""

    def __init__(self, net: Gru):
        self.m = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES if n != "x"}
        self.v = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES if n != "x"}
        self.sum, self.steps = np.zeros(len(net.x), np.float32), 0

    def apply(self, net: Gru, grads: dict, tokens: int, rate: float) -> None:
        self.steps += 1
        scale, late = np.float32(rate / (1 - 0.9**self.steps)), np.float32(1 / (1 - 0.99**self.steps))
        for n, m in self.m.items():
            g, v = grads[n] * np.float32(1 / tokens), self.v[n]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            a = getattr(net, n)
            a -= scale * m / (np.sqrt(v * late) + np.float32(1e-6))
        for n, most in (("wc", 3), ("ww", 3), ("bc", 20), ("bw", 30)):  # states are within 1, so no exponential overflows
            np.clip(getattr(net, n), -most, min(most, 20), out=getattr(net, n))
        rows, g = grads["x"]
        g = g * np.float32(1 / tokens)
        self.sum[rows] += (g * g).mean(axis=1)
        net.x[rows] -= np.float32(8 * rate) * g / (np.sqrt(self.sum[rows])[:, None] + np.float32(1e-8))


def _average(models: DataFrame, least: int = 16) -> np.ndarray | None:
    """Mean of parameters by tokens, from rows (part, n, model). While there are more than `least`, each sixteen next to each
    other become one, so no task and not the driver holds more; sums are in the order of `part`, the same in each run."""

    def add(batches):
        total, weight, held = None, 0.0, None
        for batch in batches:
            for part, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if held is not None and part // least != held:
                    yield one(held, weight, total)
                    total, weight = None, 0.0
                held, a = part // least, np.frombuffer(raw.as_buffer(), np.float32).astype(float) * n
                total, weight = (a if total is None else total + a), weight + n
        if total is not None:
            yield one(held, weight, total)

    def one(part, n, total):
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()])], names=["part", "n", "model"])

    hold, turn = Scratch(models.sparkSession), 0
    models = hold.save(models, "models0")
    while (most := models.agg(F.max("part")).first()[0] or 0) >= least:
        turn += 1
        near = models.repartition(most // least + 1, F.floor(F.col("part") / least)).sortWithinPartitions("part")
        models = hold.save(near.mapInArrow(add, "part long, n double, model binary"), f"models{turn}")
        hold.drop(f"models{turn - 1}")
    got = models.orderBy("part").collect()
    hold.drop(f"models{turn}")
    if not got:
        return None
    return sum(np.frombuffer(r["model"], np.float32).astype(float) * r["n"] for r in got) / sum(r["n"] for r in got)


def train(coded: DataFrame, words: Words, rounds: int = 4, width: int = 16, held_tokens: int = 3_000_000) -> Gru:
    """Data-parallel training: each round reads its share of the training documents, by hash, and each training document is
    in one round; every task goes on from the mean of the last round's models. A task holds `held_tokens` tokens at a time."""
    spark: SparkSession = coded.sparkSession
    model = Gru(words, width)
    bucket = F.pmod(F.xxhash64(F.lit(31), "doc_id", "n_tokens"), F.lit(rounds))
    for k in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def learn(batches, now=now, rate=0.012 / (1 + 0.5 * k), kind=words.kind):
            own = copy.deepcopy(now.value)
            rates, docs, n, size = Rates(own), [], 0, 0
            for batch in batches:
                for x in batch.column(0):
                    docs.append(np.frombuffer(x.as_buffer(), kind))
                    size += len(docs[-1])
                    if size >= held_tokens:
                        n, docs, size = n + own.train(docs, rate=rate, rates=rates), [], 0
            n += own.train(docs, rate=rate, rates=rates)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([float(n)]), pa.array([own.get()])], names=["part", "n", "model"])

        some = coded.filter(~F.col("held") & (bucket == k))
        mean = _average(some.select("numbers").mapInArrow(learn, "part long, n double, model binary"))
        if mean is not None:
            model.put(mean)
        now.unpersist()
    return model


def score(docs: DataFrame, shortlist: int | None = None, **how) -> DataFrame:
    """`docs` has doc_id, text and held_out; returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `shortlist` sets the number of words with a softmax of their own; by default it grows with the vocabulary."""
    spark = docs.sparkSession
    hold = Scratch(spark)
    docs = docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    chunks = hold.save(_chunks(docs), "chunks", "zstd")  # small numbers in wide fields
    rows = _spread(chunks)
    counts = hold.save(rows.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    words = Words(counts, shortlist)
    top = F.when(F.col("c") >= words.least, F.col("word")).otherwise(F.lit(0)).alias("top")
    counted = rows.select("word", "chunk", "place").join(counts, "word").select("chunk", "place", "c", top)
    coded = hold.save(_coded(chunks, counted, words), "coded", "zstd")
    hold.drop("chunks")
    hold.drop("counts")
    model = spark.sparkContext.broadcast(train(coded, words, **how))

    def scored(batches):
        for batch in batches:
            size = np.cumsum(batch.column(3).to_numpy())
            cuts = np.flatnonzero(np.diff(size // SCORE_TOKENS, prepend=0, append=-1))
            for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
                if a < b:
                    part = batch.slice(a, b - a)
                    net = model.value.score([np.frombuffer(x.as_buffer(), words.kind) for x in part.column(1)])
                    yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(i) for i in range(2, 7)), pa.array(net)], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "rare", "net"])

    kind = _with(docs.schema["doc_id"].dataType, "held_out boolean, n_tokens long, n_known long, logs double, rare double, net double")
    out = coded.select("doc_id", "numbers", "held", "n_tokens", "n_known", "logs", "rare").mapInArrow(scored, kind)
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(words.tokens + words.kinds + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("net") + F.col("rare")).alias("score"))
