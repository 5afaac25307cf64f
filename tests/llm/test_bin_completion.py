"""Bin completion against instances whose fewest bins are known."""

import random
from collections import Counter

import pytest

from kinweave.llm import packing


def bins_of(counts, plan, capacity):
    used = Counter()
    for need, times in plan:
        assert times > 0 and sum(k * c for k, c in need.items()) <= capacity
        for k, c in need.items():
            used[k] += c * times
    assert used == counts
    return sum(times for _, times in plan)


@pytest.mark.parametrize("n", [20, 60, 100, 200])
def test_triplets(n):
    """Lengths cut from full bins in threes: every bin of the best packing is full."""
    for seed in range(2):
        rng, lengths = random.Random(seed), []
        for _ in range(n):
            a = rng.randint(780, 1000)
            b = rng.randint(512, (2048 - a) // 2)
            lengths += [a, b, 2048 - a - b]
        counts = Counter(lengths)
        assert bins_of(counts, packing.fillings(counts), 2048) == n


def test_waste_bound_prunes():
    left = packing._Counts({10: 3, 7: 2, 3: 5})
    assert packing._completions(left, 10, 20, 0, 100, 9) == [(0, (10, 10)), (0, (10, 7, 3))]
    assert packing._all_fillings({10: 1, 7: 1}, 20, 2, 10) == [] and packing._all_fillings({10: 1, 7: 1}, 20, 3, 10) == [(3, (10, 7))]
    assert len(packing._all_fillings({k: 9 for k in range(1, 9)}, 20, 0, 10)) <= 10


def test_unpackable_lengths_meet_the_half_bound():
    counts = Counter({1100: 500, 1030: 300, 900: 10})
    assert bins_of(counts, packing.fillings(counts), 2048) == 800
    assert packing.fillings({}) == []


def test_hot_lengths_are_ranked_in_groups():
    assert [packing._salts(n) for n in (1, 1000, 50_000, 10**6, 10**9)] == [1, 1, 50, 64, 2000]


def test_packing_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, None), (1, "x " * 3000)], "doc_id long, text string").selectExpr("*", "1 as _salt", "2 as _turn", "3 as length")
    got = packing.packed(df).collect()
    assert sorted((r.doc_id is None, r.piece, r.offset >= 0) for r in got if r.doc_id is None) == [(True, 0, True)] * 2
    assert sum(r.length for r in got if r.doc_id == 1) > 3000
