"""The language model's gradients through time, its reading of all documents, and its counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import gru_lm


def network(head=70, width=4, seed=7):
    w = gru_lm.Words.__new__(gru_lm.Words)
    w.head, w.bands, w.end, w.kind = head, 3, 0, np.uint16
    w.head_classes, w.freq = -(-head // gru_lm.CLASS), np.arange(head, 0, -1.0)
    w.class_freq = np.concatenate([np.add.reduceat(w.freq, np.arange(0, head, gru_lm.CLASS)), [5.0, 4.0, 3.0]])
    return gru_lm.Gru(w, width, seed)


def test_backpropagation_through_time():
    """Every parameter's gradient over a window against finite differences, with a fresh start inside the window."""
    net, rng = network(), np.random.default_rng(1)
    for n in ("x", "u", "wc", "ww"):
        getattr(net, n)[...] = rng.normal(0, 0.5, getattr(net, n).shape)
    steps, lanes = 7, 5
    x, y = rng.integers(0, 73, (steps, lanes)), rng.integers(0, 73, (steps, lanes))
    fresh = rng.random((steps, lanes)) < 0.15
    on = np.ones((steps, lanes), bool)
    on[-1, 2:] = False
    h = rng.normal(0, 0.5, (lanes, 4)).astype(np.float32)
    loss = lambda: net.window(h, x, y, fresh, on)[0]
    _, grads, _ = net.window(h, x, y, fresh, on)
    rows, sums = grads["x"]
    grads["x"] = np.zeros_like(net.x)
    grads["x"][rows] = sums
    for name in net.NAMES:
        a = getattr(net, name)
        strong = np.argsort(-np.abs(grads[name]).ravel())[:12]
        for i in [*strong, *rng.integers(0, a.size, 6)]:
            at = np.unravel_index(i, a.shape)
            if name == "bw" and at[0] >= 70:
                continue
            kept, eps = a[at], 2e-2
            a[at] = kept + eps
            up = loss()
            a[at] = kept - eps
            down = loss()
            a[at] = kept
            assert (up - down) / (2 * eps) == pytest.approx(grads[name][at], abs=0.02, rel=0.02), (name, at)


def test_training_reads_every_token_and_learns():
    """A sequence that only the past tells; lanes and windows do not change how much is read."""
    docs = [np.array(([3, 9, 40] * 20)[k % 3 : 50 + k % 3] + [0], np.uint16) for k in range(120)]
    net = network()
    before = net.score(docs).sum()
    for _ in range(6):
        assert net.train(docs, lanes=8) == sum(map(len, docs))
    assert net.score(docs).sum() > 0.5 * before
    assert network().train([]) == 0 and network().train([docs[0][:1]]) == 1


def test_every_training_document_is_in_one_round(spark, monkeypatch):
    """The tokens that the tasks report add up to all training tokens."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("repeat('a b ', 5 + cast(id % 7 as int))").alias("text"), (F.col("id") % 5 == 0).alias("held_out"))
    read, average = [], gru_lm._average

    def counted(models, **how):
        read.append(models.agg(F.sum("n")).first()[0])
        return average(models, **how)

    monkeypatch.setattr(gru_lm, "_average", counted)
    got = gru_lm.score(docs).collect()
    assert sum(read) == sum(r.n_tokens for r in got if not r.held_out) == got[0].train_tokens


def test_models_are_averaged_in_levels(spark):
    rng = np.random.default_rng(2)
    models = [(i, float(rng.integers(1, 9)), rng.normal(size=3).astype(np.float32)) for i in range(300)]
    df = spark.createDataFrame([(i, n, bytearray(m.tobytes())) for i, n, m in models], "part long, n double, model binary")
    want = sum(n * m for _, n, m in models) / sum(n for _, n, _ in models)
    assert np.allclose(gru_lm._average(df), want, atol=1e-5) and gru_lm._average(df.limit(0)) is None


def test_rows_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b", False), (None, "a b", False), (1, None, True), (1, "", True), (2, "b " * 5000, False)], "doc_id long, text string, held_out boolean")
    got = gru_lm.score(docs).collect()
    assert len(got) == 5 and sorted(r.n_tokens for r in got) == [1, 1, 3, 3, 5001]
    assert len({r.score for r in got if r.doc_id is None}) == 1 and all(r.score < 0 for r in got)
