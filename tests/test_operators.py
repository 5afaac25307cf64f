from itertools import product

from pyspark.sql import functions as F

from kinweave.operators import cluster, constraints, events, households, linkage, persons
from kinweave.plans import catalogue, findings

SF = "/root/testdata/sf0.001"


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), *((i, i + 1) for i in range(100, 160))], "a long, b long")
    found = dict(map(tuple, cluster.connected_components(edges).collect()))
    assert found[3] == 1 and found[5] == 4 and found[9] == 9 and found[160] == 100
    assert cluster.connected_components(edges.limit(0)).count() == 0
    near = dict(map(tuple, cluster.degrees(edges, spark.createDataFrame([(1,)], "node long"), 2).collect()))
    assert near == {1: 0, 2: 1, 3: 2}


def test_purge(spark):
    m = spark.createDataFrame([(1, "A", 3), (1, "B", 4), (1, "C", 4)], "component long, id string, source_id int")
    assert [r.id for r in cluster.purge_same_source(m).collect()] == ["A"]


def test_birth_buckets(spark):
    years = {1: [1860, 1861, 1863], 2: [1860, 1865], 3: [None]}
    rows = [(p * 10 + i, p, y) for p, ys in years.items() for i, y in enumerate(ys)]
    links = spark.createDataFrame([(p, r) for r, p, _ in rows], "person_id long, recorded_person_id long")
    ppl = spark.createDataFrame([(r, y) for r, _, y in rows], "recorded_person_id long, birth_year int")
    got = {(r.person_id, r.bucket): (r.votes, r.is_primary) for r in events.birth_buckets(links, ppl).collect()}
    assert got == {(1, 1860): (2, 1), (1, 1863): (1, 0), (2, 1860): (1, 1), (2, 1865): (1, 0)}


def test_greedy(spark):
    rows = [r.asDict() for r in catalogue._member_pairs(*_views(spark, "person_row", "record")).collect()]
    want = set()
    for key in {(r["record_id_1"], r["record_id_2"]) for r in rows}:
        mine, used = [r for r in rows if (r["record_id_1"], r["record_id_2"]) == key], set()
        for p in sorted({r["position_1"] for r in mine}):
            free = sorted((r for r in mine if r["position_1"] == p and r["position_2"] not in used and r["score"] > 0.6), key=lambda r: (-r["score"], r["position_2"]))
            if free:
                used.add(free[0]["position_2"])
                want.add((free[0]["id_1"], free[0]["id_2"]))
    got = [(r.id_1, r.id_2) for r in catalogue.QUERIES["greedy_member_matches"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def _views(spark, *names):
    return [catalogue.view(spark, SF, n) for n in names]


def test_household_extension(spark):
    rows, link = _views(spark, "recorded_person", "link")
    members = [r.asDict() for r in households.members_ordered(rows).collect()]
    person = {r.recorded_person_id: r.person_id for r in link.filter("recorded_person_id % 100 <= 2").collect()}
    of, edges, want = {}, {}, set()
    for rp, p in person.items():
        of.setdefault(p, set()).add(rp)
    for r in catalogue.roles.role_pairs(rows).collect():
        for a, b in ((r.recorded_person_id_1, r.recorded_person_id_2), (r.recorded_person_id_2, r.recorded_person_id_1)):
            edges.setdefault(a, []).append((b, r.score))
    homes = {}
    for m in sorted(members, key=lambda m: m["position"]):
        homes.setdefault(m["record_id"], []).append(m["recorded_person_id"])
    for ids in homes.values():
        anchors = set().union(*(of[person[i]] for i in ids if i in person), set())
        for i in [i for i in ids if i not in person] if anchors else []:
            if ways := [s for b, s in edges.get(i, []) if b in anchors]:
                anchors.add(i)
                want.add((i, max(ways)))
    got = {(r.recorded_person_id, r.score) for r in catalogue.QUERIES["household_resolution"](spark, SF).collect()}
    assert got == want and want


def test_relationship_resolution_invariants(spark):
    rows, link = _views(spark, "person_row", "link")
    got = catalogue.QUERIES["relationship_resolution"](spark, SF)
    assert got.count() == got.select("recorded_person_id").distinct().count()
    # nothing that was linked before is lost
    assert link.join(got, "recorded_person_id", "left_anti").count() == 0


def test_em_orders_levels(spark):
    out = catalogue.QUERIES["em_person_similarity"](spark, SF).collect()
    assert out and all(0.3 <= r.score <= 1 and r.source_1 != r.source_2 and r.id_1 < r.id_2 for r in out)
    settings, truth = catalogue.NARROW, 0.2
    m, u = [0.02, 0.03, 0.05, 0.9], [0.9, 0.05, 0.03, 0.02]
    counts = []
    for g in product(range(4), range(4), range(2), range(2), range(4)):
        pm = pu = 1.0
        for c, level in zip(settings.comparisons, g, strict=True):
            n = len(c.levels)
            pm, pu = pm * (m[level] if n == 4 else (0.1, 0.9)[level]), pu * (u[level] if n == 4 else (0.5, 0.5)[level])
        counts += [{"match_key": k, "count": 1e6 * (truth * pm + (1 - truth) * pu)} | {f"gamma_{c.name}": x for c, x in zip(settings.comparisons, g, strict=True)} for k in (0, 1)]
    known = {c.name: u if len(c.levels) == 4 else [0.5, 0.5] for c in settings.comparisons}
    found = linkage.estimate(counts, settings, known)
    assert abs(found["sex_as_recorded"][1] - 0.9) < 0.02 and found["forename_class"][3] > 0.85


def test_persons_have_one_row_per_source(spark):
    sim, rows = _views(spark, "similarity", "person_row")
    constraints.assert_one_per_source(persons.resolve(sim, rows), rows)


def test_priorities(spark):
    got = catalogue.QUERIES["priority_rank"](spark, SF).orderBy("priority").collect()
    assert [r.priority for r in got] == list(range(1, len(got) + 1))
    assert all(a.raw_score <= b.raw_score for a, b in zip(got, got[1:], strict=False))


def test_report(spark, tmp_path):
    import json

    found = findings.finding(spark.createDataFrame([(1,)], "person_id long"), "merge_error_candidate", F.lit("title"), "act").withColumn("priority", F.lit(1))
    js, md = findings.write_report(found, str(tmp_path))
    assert json.load(open(js))["summary"] == {"merge_error_candidate": 1} and "title" in open(md).read()


def test_cascade(spark):
    ppl, links = spark.createDataFrame([(1,), (2,)], "person_id long"), spark.createDataFrame([(1, 5)], "person_id long, recorded_person_id long")
    rel = spark.createDataFrame([(1, 2)], "person_id_1 long, person_id_2 long")
    out = households.without_persons({"person": ppl, "relationship": rel}, households.orphans(ppl, links))
    assert [r.person_id for r in out["person"].collect()] == [1] and out["relationship"].count() == 0
