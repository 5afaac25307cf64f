"""Learned credential spans: parts of longer runs, ordinary tokens, formats that were never labelled."""

import random
import string

import pytest

from kinweave.llm import secret_scan

A = string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def model():
    return secret_scan.SecretModel()


def drawn(rng, n, chars=A):
    return "".join(rng.choices(chars, k=n))


def test_credentials_inside_runs(model):
    rng = random.Random(5)
    code = "ghp_" + drawn(rng, 36)
    for text in (f"GITHUB={code}", f"use {code}.", f"https://x.y/{code}/z", f"//{code}@host", f"deadbeefdeadbeefdeadbeef/{code}", f"é{code}é", f"see {code}/{'word.' * 2000}"):
        a = text.index(code)
        assert (a, 3, "code_host", a + len(code)) in model.spans(text)[1], text
    whole = ["xoxb-123456789012-1234567890123-" + drawn(rng, 24), "eyJhbGciOiJSUzI1NiJ9.eyJ" + drawn(rng, 70) + "." + drawn(rng, 86, A + "-_"), "AIza" + drawn(rng, 35)]
    assert [model.kind(t) for t in whole] == ["chat", "signed", "cloud_key"]
    # held by a base span, so not said again; two side by side are both found
    assert model.spans(f"token={code}")[1] == [] and len(model.spans(f"{code}/{code}")[1]) == 2


def test_against_every_part(model):
    """The spans of short runs against the score of every part, one after the other."""
    rng = random.Random(6)
    for _ in range(30):
        run = rng.choice("=/._-").join(rng.choice(["word", "ghp_" + drawn(rng, 36), "sk_live_" + drawn(rng, 24), "1234"]) for _ in range(3))
        cuts = [0, *(i + 1 for i, c in enumerate(run) if c in secret_scan.MARKS)], [*(i for i, c in enumerate(run) if c in secret_scan.MARKS), len(run)]
        scored, symbols = [], secret_scan.classes(run)
        for a in cuts[0]:
            for b in (b for b in cuts[1] if b - a >= secret_scan.SHORTEST):
                back = max(sum(c.log[x, y] for x, y in list(zip(["", *symbols], symbols, strict=False))[a:b]) for c in model.chains)
                for name, auto in model.automata.items():
                    totals = list(auto.walk(run[a:b]))
                    if len(totals) == b - a and (s := totals[-1] + auto.size.get(b - a, auto.other_size) - back) > model.margin:
                        scored.append((-s, a, -b, name))
        top = {}
        for s, a, b, name in sorted(scored):
            top.setdefault((a, -b), (-s - model.margin, name))

        def most(free):
            """The highest sum of parts that begin at `free` or later, tried one and all."""
            return max([(0.0, [])] + [(gain + (rest := most(b))[0], [(a, b, name), *rest[1]]) for (a, b), (gain, name) in top.items() if a >= free], key=lambda x: x[0])

        got = model.learned(run)
        assert sum(top[a, b][0] for a, b, _ in got) == pytest.approx(most(0)[0]) and all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))
        assert all(top[a, b][1] == name for a, b, name in got)


def test_ordinary_tokens_pass(model):
    tokens = [t for ts in secret_scan.ordinary(200, seed=77).values() for t in ts]
    assert sum(bool(model.learned(t)) for t in tokens) <= len(tokens) // 500
    assert model.learned("f81d4fae-7dec-11d0-a765-00a0c91e6bf6") == [] and model.learned("internationalization-and-localization") == []


def test_formats_never_labelled(model):
    rng = random.Random(8)
    for start, n in (("glpat-", 20), ("npm_", 36), ("hf_", 34)):
        assert sum(bool(model.learned(start + drawn(rng, n))) for _ in range(40)) >= 36


def test_automaton_learns_a_grammar():
    """A letter, a digit, and again: states merge into that loop, and unseen repeats keep nearly all their probability."""
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice(string.ascii_lowercase) + rng.choice(string.digits) for _ in range(n))
    words = []
    for _ in range(600):
        n = 1
        while rng.random() < 0.8:
            n += 1
        words.append(make(n))
    auto = secret_scan.Automaton(words)
    assert len(auto.red) <= 6
    longer, wrong = list(auto.walk(make(40))), list(auto.walk("ab" * 12))
    assert len(longer) == 80 and len(wrong) < 12


def test_nulls_and_ties(spark, model):
    code = "ghp_" + "aB3x" * 9
    df = spark.createDataFrame([(None, code), (None, code), (1, None), (1, "")], "doc_id long, text string").selectExpr("*", "1 as n_hex", "'x' as kind")
    got = secret_scan.scan(df, model).select("doc_id", "_secrets.*").collect()
    assert [r.spans for r in got] == ["code_host:0:40", "code_host:0:40", "", ""]
