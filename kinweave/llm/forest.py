"""Quality rules: an isolation forest on rule statistics of whole texts, its threshold set from labelled rows.

Words are runs outside `[\\x20\\x09-\\x0D]`; a null or empty text has none, and the base rules reject it.
Repeated rows are judged alike. An empty table gives an empty result. Trees draw their rows from all labelled good ones,
and the threshold counts the scores of all labelled rows. Without labels all documents stand in for them, and the
threshold rejects the `unlabelled` share of these.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import Scratch, bloom

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[^\W\d_]+")
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Scores are counted in steps of 1/STEPS, so that the counts of any number of rows are a small table.
STEPS, DRAW_SEED = 100_000, 11


def statistics(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """(the BASE counts, the forest's features) of a text."""
    text = text or ""
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup_lines = len(lines) - len(set(lines))
    repeated, kinds = 0, len(set(words))
    if n >= 4 and kinds < n:
        codes: dict[str, int] = {}
        ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
        pairs = np.unique(ids[:-1] * len(codes) + ids[1:], return_inverse=True)[1]
        _, at, times = np.unique(pairs[:-1] * len(codes) + ids[2:], return_inverse=True, return_counts=True)
        many = times[at] > 1
        mark = np.zeros(n, bool)
        for i in range(3):
            mark[i : i + len(many)] |= many
        repeated = int(mark.sum())
    base = (n, chars, symbols, dup_lines, repeated)
    if not n:
        return base, [0.0] * FEATURES
    size = max(1, len(text))
    letters = LETTER.findall(text)
    n_letters = sum(map(len, letters))
    upper = sum(1 for w in letters if w.isupper() and len(w) > 1)
    ends = sum(text.count(c) for c in ".,;:?")
    return base, [
        chars / n, symbols / size * 100, dup_lines / max(1, len(lines)), repeated / n, kinds / n if n < 200 else min(1.0, kinds / n * (n / 200) ** 0.3),
        n_letters / max(1, chars), upper / max(1, len(letters)), text.count("!") / n, ends / n, sum(c in text for c in "|{}[]<>"),
        np.log1p(chars / max(1, len(lines))), sum(text.count(c) for c in "0123456789") / size,
    ]


FEATURES = 12


class IsolationForest:
    """Trees of random splits over subsamples, as arrays; a score near 1 is a short path, an anomaly."""

    def __init__(self, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 5, drawn: list[np.ndarray] | None = None):
        """Trees draw from the rows `x`, or have the rows of each in `drawn`."""
        rng = np.random.default_rng(seed)
        self.sample = max(2, min(sample, len(x) if drawn is None else max(map(len, drawn))))
        self.depth = int(np.ceil(np.log2(self.sample)))
        nodes = (1 << (self.depth + 1)) - 1
        self.feature = np.zeros((trees, nodes), np.int16)
        self.cut = np.full((trees, nodes), np.inf)
        self.path = np.zeros((trees, nodes))
        for t in range(trees):
            rows = drawn[t] if drawn is not None else x[rng.choice(len(x), self.sample, replace=False)] if len(x) >= self.sample else x
            self._grow(t, 0, 0, rows, rng)

    @staticmethod
    def _rest(n: int) -> float:
        """Mean path length of an unbuilt subtree of n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, t, node, depth, rows, rng):
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        wide = np.flatnonzero(high > low)
        if depth == self.depth or not len(wide):
            while node < self.path.shape[1]:  # rows that end here run down the left side
                self.path[t, node] = depth + self._rest(len(rows))
                node = 2 * node + 1
            return
        f = int(rng.choice(wide))
        cut = rng.uniform(low[f], high[f])
        self.feature[t, node], self.cut[t, node] = f, cut
        right = rows[:, f] > cut
        self._grow(t, 2 * node + 1, depth + 1, rows[~right], rng)
        self._grow(t, 2 * node + 2, depth + 1, rows[right], rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.cut)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            total += self.path[t, at]
        return 2.0 ** (-total / len(self.cut) / max(1e-9, self._rest(self.sample)))


def threshold(scores: np.ndarray, good: np.ndarray, most_lost: float) -> float:
    """The score over which rows are rejected: the best balanced accuracy that loses at most `most_lost` of the good."""
    if not good.any() or good.all():
        return float(np.quantile(scores, 1 - most_lost)) if len(scores) else 1.0
    floor = np.quantile(scores[good], 1 - most_lost, method="higher")
    cuts = np.unique(scores[scores >= floor])
    bad, fine = np.sort(scores[~good]), np.sort(scores[good])
    hit = 1 - np.searchsorted(bad, cuts, side="right") / len(bad)
    lost = 1 - np.searchsorted(fine, cuts, side="right") / len(fine)
    return float(cuts[np.argmax(hit - lost)])


def rejected(base: tuple[int, ...]) -> bool:
    """The base rules: too few words, or too many in repeated windows."""
    return base[0] < 50 or 100 * base[4] > 50 * base[0]


def _features(texts) -> list:
    """Features of the texts that the base rules let pass, else None: they need no forest."""
    return [None if rejected(base) else x for base, x in map(statistics, texts)]


def _features_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id and x, the features, of the documents that may be among `keys`.

    One pass both asks and counts: as two functions they would take two Python workers in each running task, and
    executors keep these with all that later queries load in them."""
    asked = bloom(keys, "key")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            some = batch.filter(pa.array(asked(batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays([some.column(1), pa.array(_features(some.column(2).to_pylist()), pa.list_(pa.float64()))], names=schema.names)

    return docs.filter("doc_id is not null").select(F.xxhash64("doc_id").alias("key"), "doc_id", "text").mapInArrow(run, schema)


def threshold_of_counts(steps: np.ndarray, good: np.ndarray, bad: np.ndarray, most_lost: float) -> float:
    """`threshold` of the scores steps / STEPS, rising, that `good` and `bad` rows have."""
    upto_good, upto_bad = np.cumsum(good), np.cumsum(bad)
    if not upto_good[-1] or not upto_bad[-1]:
        at = (1 - most_lost) * (upto_good[-1] + upto_bad[-1] - 1)
        low, high = (steps[np.searchsorted(upto_good + upto_bad, k, side="right")] for k in (int(np.floor(at)), int(np.ceil(at))))
        return float(low + (high - low) * (at - np.floor(at))) / STEPS
    floor = np.searchsorted(upto_good, int(np.ceil((1 - most_lost) * (upto_good[-1] - 1))), side="right")
    gain = (1 - upto_bad / upto_bad[-1]) - (1 - upto_good / upto_good[-1])
    return float(steps[floor + np.argmax(gain[floor:])]) / STEPS


def _drawn(rows: DataFrame, n: int, trees: int, sample: int) -> list[np.ndarray]:
    """For each tree the `sample` rows that a seeded hash puts first among all n rows (doc_id, x): about 2*sample of each come here."""
    span = 1 << 31
    limit = min(span, 2 * sample * span // n + 1)
    place = lambda t: F.pmod(F.xxhash64(F.lit(DRAW_SEED), "doc_id", t), F.lit(span))
    put = rows.select("doc_id", "x", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: place(t) < limit)).alias("tree"))
    got = put.withColumn("place", place(F.col("tree"))).toPandas()
    got["x"] = got["x"].map(tuple)
    got = got.sort_values(["tree", "place", "x"], kind="stable")
    of = {t: np.array(g["x"].head(sample).tolist()).reshape(-1, FEATURES) for t, g in got.groupby("tree")}
    return [of.get(t, np.zeros((0, FEATURES))) for t in range(trees)]


class QualityJudge:
    """Fitted on all labelled rows; judges any number of texts."""

    def __init__(self, docs: DataFrame, labels: DataFrame, most_lost: float = 0.005, unlabelled: float = 0.02, trees: int = 100, sample: int = 256, **how):
        hold = Scratch(docs.sparkSession)
        vector = pandas_udf(lambda s: pd.Series(_features(s)), "array<double>")
        some = labels.filter("quality is not null and doc_id is not null").select("doc_id", "quality")
        # documents without a label are left out before features are counted, and no text is shuffled
        known = _features_of(docs, some.select(F.xxhash64("doc_id").alias("key")).distinct())
        known = hold.save(known.join(some, "doc_id").select("doc_id", "x", (F.col("quality") >= 1).alias("good")), "labelled")
        if known.isEmpty():
            known = hold.save(docs.select("doc_id", vector("text").alias("x"), F.lit(True).alias("good")), "unlabelled")
            most_lost = unlabelled
        known = known.filter("x is not null")
        n, n_good = known.agg(F.count(F.lit(1)), F.count_if(F.col("good"))).first()
        self.forest, self.cut = None, 1.0
        if not n:
            return
        self.forest = IsolationForest(np.zeros((0, FEATURES)), trees, sample, drawn=_drawn(known.filter("good") if n_good else known, n_good or n, trees, sample), **how)
        sent = docs.sparkSession.sparkContext.broadcast(self.forest)

        @pandas_udf("int")
        def step(x: pd.Series) -> pd.Series:
            return pd.Series(np.rint(sent.value.score(np.array(x.tolist()).reshape(-1, FEATURES)) * STEPS).astype(np.int32))

        # at most 2*STEPS rows, whatever the number of labels
        counts = known.select(step("x").alias("step"), "good").groupBy("step").agg(F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas().sort_values("step")
        self.cut = threshold_of_counts(*(counts[c].to_numpy() for c in ("step", "good", "bad")), most_lost)

    def verdicts(self, texts: list[str | None]) -> pd.DataFrame:
        found = [statistics(t) for t in texts]
        out = pd.DataFrame([f[0] for f in found], columns=list(BASE), dtype="int64")
        x = np.array([f[1] for f in found]).reshape(-1, FEATURES)
        out["base_failed"] = np.array([rejected(f[0]) for f in found], bool)
        out["anomaly"] = np.rint(self.forest.score(x) * STEPS) / STEPS if self.forest and len(x) else 0.0
        out["kept"] = ~out["base_failed"] & (out["anomaly"] <= self.cut)
        return out


def judged(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """`docs` with a struct `_quality`: the BASE counts, base_failed, anomaly (the score) and kept."""
    judge = docs.sparkSession.sparkContext.broadcast(QualityJudge(docs, labels, **how))
    schema = ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, anomaly double, kept boolean"

    @pandas_udf(schema)
    def verdict(texts: pd.Series) -> pd.DataFrame:
        return judge.value.verdicts(texts.tolist())

    return docs.withColumn("_quality", verdict("text"))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """`docs` without the rows that the base rules or the forest reject; all columns kept, whatever their names."""
    known = docs.select("doc_id", "text")
    judge = QualityJudge(known, labels, **how)
    held = docs.sparkSession.sparkContext.broadcast(judge)

    @pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return held.value.verdicts(texts.tolist())["kept"]

    return docs.filter(kept("text"))
