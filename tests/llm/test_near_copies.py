import random

import brute

from kinweave.llm import simhash


def shingles(text):
    w = brute.words((text or "").translate(brute.UP))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near(a, b):
    x, y = shingles(a), shingles(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def planted(seed=3):
    """Texts of 60 to 400 words, most with changed words, and one large group; similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    out = []
    for k in range(60):
        base = rng.choices(words, k=rng.randint(60, 400))
        out.append(base)
        for _ in range(30 if k == 0 else 2):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, len(copy) // rng.choice([40, 60, 120]))):
                copy[at] = "new" + str(rng.random())
            out.append(copy)
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_planted_near_copies(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(set(brute.linked(rows, near).values()))
    assert len(want) < len(rows) - 30
    assert sorted(r.doc_id for r in simhash.drop_near_copies(df).collect()) == want


def test_large_groups(spark):
    """Above `direct`, no pair is below 0.8, and few of the links are lost."""
    rows = planted()
    df = spark.createDataFrame(rows, "_row long, text string")
    comps = brute.linked(rows, near)
    edges = [(r.a, r.b) for r in simhash.similar_pairs(df, simhash.Scratch(spark), direct=2).collect()]
    assert all(near(rows[a][1], rows[b][1]) for a, b in edges)
    found = brute.linked(rows, lambda x, y, e={(rows[a][1], rows[b][1]) for a, b in edges}: (x, y) in e or (y, x) in e)
    assert len(set(comps.values())) <= len(set(found.values())) <= len(set(comps.values())) + 4


def test_null_and_repeated_ids(spark):
    rng = random.Random(5)
    make = lambda: " ".join(f"v{rng.randrange(9999)}" for _ in range(100))
    a, b, c, lone, other = make(), make(), make(), make(), make()
    rows = [(1, a), (None, a + " x"), (None, lone), (7, b), (2, b + " x"), (7, other), (None, c), (None, c + " x")]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in kept if not (r.text or "").startswith(c)} == {(1, a), (None, lone), (2, b + " x"), (7, other)}
    assert len(kept) == 5


def classes(rows, edges):
    linked = {(rows[a][1], rows[b][1]) for a, b in edges}
    return brute.linked(rows, lambda x, y: (x, y) in linked or (y, x) in linked)


def one_cluster(seed=8):
    """Copies of one text, others that share a long part with it, and texts that link to a copy only; far above any limit."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    out = []
    for k in range(90):
        copy = list(base)
        start = 0 if k % 3 else 60
        for at in rng.sample(range(start, 120), 1 if k % 3 else 2):
            copy[at] = f"n{rng.random()}"
        out.append(copy if k % 5 else base[:70] + [f"o{rng.random()}" for _ in range(rng.randint(5, 60))])
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_no_link_is_lost_in_groups_of_any_size(spark):
    """The classes are those of brute force where groups are compared by pairs, in one task, keyed anew, and dealt over tasks."""
    small = {"direct": 2, "most": 6}
    for rows, ways in ((planted(), [{"direct": 2}]), (one_cluster(), [{}, small, {"direct": 2, "bytes_most": 9000}])):
        df = spark.createDataFrame(rows, "_row long, text string")
        want = brute.linked(rows, near)
        for limits in ways:
            edges = [(r.a, r.b) for r in simhash.similar_pairs(df, simhash.Scratch(spark), **limits).collect()]
            assert all(near(rows[a][1], rows[b][1]) for a, b in edges)
            assert classes(rows, edges) == want, limits


def test_texts_in_one_task():
    rows = planted()[:60] + [(60, None), (61, ""), (62, " \n")]
    texts = [t for _, t in rows]
    edges = simhash.link_alike(texts, 0.8)
    rows = [(i, t) for i, t in enumerate(texts)]
    assert classes(rows, edges) == brute.linked(rows, near)
    assert len(edges) < len(texts)


def test_one_huge_group_is_dealt_over_tasks(spark):
    """A group of rows most of which link to none of those they are dealt with: what strays is compared with all."""
    for rows in (planted()[:40], one_cluster()[:40]):
        df = spark.createDataFrame(rows, "_row long, text string")
        members = df.selectExpr("_row", "cast(octet_length(text) as long) as size", "7L as key")
        large = members.groupBy("key").agg({"*": "count", "size": "sum"}).toDF("key", "n", "w")
        none = df.selectExpr("_row as a", "_row as b").filter("a < 0")
        edges = simhash._huge(members, large, none, df, simhash.Scratch(spark), 0.8, most=6, bytes_most=1 << 20)
        assert classes(rows, [(r.a, r.b) for r in edges.collect()]) == brute.linked(rows, near)
