"""Language identification by error-correcting output codes.

Each language has a codeword; binary classifiers on hashed byte n-grams of the whole lower-cased text predict
its bits, and loss-weighted decoding takes the nearest codeword. A text that is null or has no letter is
`und` with score 0. Near ties are flagged ambiguous; equal losses go to the smaller language name. Repeated
rows get the same language. With no labelled text all are `und`; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(rb"[\x00-\x60\x7b-\x7f]+")
WIDTH = 4096
#: Training rows of a language, and of all: the documented bound of the fit.
ROWS_PER_LANG, ROWS = 400, 4000


def vector(text: str | None) -> np.ndarray | None:
    """Unit vector of square roots of hashed 1- to 4-gram counts of a text; None without a letter."""
    if not text or not LETTER.search(text):
        return None
    raw = b" " + NOT_LETTERS.sub(b" ", text.lower().encode("utf-8", "replace")) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    total, h = np.zeros(WIDTH), np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        total += np.bincount((mixed >> np.uint32(20)).astype(np.int64), minlength=WIDTH)
    root = np.sqrt(total, dtype=np.float32)
    return root / np.linalg.norm(root)


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n rows of +-1: all splits for up to six classes, else random words with the largest least distance of 50 draws."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        k = np.arange(1, 1 << (n - 1))
        return np.array([np.where(k >> i & 1, 1, -1) if i < n - 1 else -np.ones(len(k)) for i in range(n)], np.int8)
    rng, size = np.random.default_rng(seed), int(np.ceil(15 * np.log2(n)))
    draws = [rng.choice(np.array([-1, 1], np.int8), (n, size)) for _ in range(50)]
    least = [min((d[i] != d[j]).sum() for i in range(n) for j in range(i)) for d in draws]
    return draws[int(np.argmax(least))]


class LanguageModel:
    """Codewords, one logistic classifier per bit, and a weight per bit from its training loss."""

    def __init__(self, x: np.ndarray, lang: list[str], steps: int = 120, rate: float = 8.0, decay: float = 1e-4, close: float = 0.2):
        self.langs, self.close = sorted(set(lang)), close
        self.code = codewords(len(self.langs)).astype(np.float32)
        at = np.array([self.langs.index(k) for k in lang], np.int64)
        count = np.bincount(at, minlength=len(self.langs)).astype(np.float32)
        share = (1 / count[at] / max(1, len(self.langs)))[:, None] if len(at) else np.zeros((0, 1))
        y = self.code[at]
        w, v = np.zeros((WIDTH, self.code.shape[1]), np.float32), 0.0
        x = x.astype(np.float32)
        for _ in range(steps if len(self.langs) > 1 else 0):
            push = y / (1 + np.exp(y * (x @ w)))
            v = 0.9 * v + (x.T @ (push * share) - decay * w)
            w = w + np.float32(rate) * v.astype(np.float32)
        self.w = w
        loss = (np.logaddexp(0, -y * (x @ w)) * share).sum(axis=0) if len(self.langs) > 1 else np.zeros(self.code.shape[1])
        self.weight = (1 / (0.05 + loss)).astype(np.float32)
        self.weight /= self.weight.sum()

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        out = pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "ambiguous": False})
        for start in range(0, len(texts), 512):
            got = [(i, v) for i, t in enumerate(texts[start : start + 512], start) if (v := vector(t)) is not None]
            if not got or not self.langs:
                continue
            at, x = [i for i, _ in got], np.array([v for _, v in got], np.float32)
            bits = x @ self.w
            loss = np.array([(np.logaddexp(0, -c * bits) * self.weight).sum(axis=1) for c in self.code]).T
            p = np.exp(4 * (loss.min(axis=1, keepdims=True) - loss))
            p /= p.sum(axis=1, keepdims=True)
            order = np.sort(loss, axis=1)
            out.loc[at, "lang_pred"] = [self.langs[k] for k in loss.argmin(axis=1)]
            out.loc[at, "score"] = p.max(axis=1)
            out.loc[at, "ambiguous"] = order[:, 1] - order[:, 0] < self.close if len(self.langs) > 1 else False
        return out


def fit(train: DataFrame, rows_per_lang: int = ROWS_PER_LANG, rows: int = ROWS, **how) -> LanguageModel:
    """From text and lang of `train`: of each language about `rows_per_lang` rows by hash, at most `rows` in all.

    Languages are counted first, and each keeps the share of its hashes that its bound allows, so a task sends
    few rows whatever the input; languages are few, as the model has a codeword for each."""
    known = train.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel(np.zeros((0, WIDTH)), [], **how)
    each = min(rows_per_lang, max(1, rows // len(counts)))
    shares = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 1.5 * each / n + 20 / n))])
    place = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = known.withColumn("_h", place).filter(F.col("_h") < F.element_at(shares, F.col("lang")))
    packed = pandas_udf(lambda s: pd.Series([None if (v := vector(t)) is None else v.tobytes() for t in s]), "binary")
    got = some.select("doc_id", "lang", "_h", packed("text").alias("x")).filter("x is not null").toPandas()
    got = got.sort_values(["_h", "doc_id", "lang"], kind="stable").groupby("lang", sort=True).head(each)
    x = np.array([np.frombuffer(b, np.float32) for b in got["x"]]).reshape(-1, WIDTH)
    return LanguageModel(x, got["lang"].tolist(), **how)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` with a struct `_lang` of lang_pred, score and ambiguous."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double, ambiguous boolean")
    def said(texts: pd.Series) -> pd.DataFrame:
        return held.value.predict(texts.tolist())

    return docs.withColumn("_lang", said("text"))
