"""Matching members of similar households, and what a household says about relationships."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import AUTO_COMMIT_THRESHOLD, MEMBER_MATCH_FLOOR, NAME_THRESHOLD
from ..functions import text as X
from .constraints import age_valid, census_year
from .persons import describe

ROLE_ORDER = ("head", "spouse", "son", "daughter")


def role_rank(role: Column) -> Column:
    out = F.lit(len(ROLE_ORDER) + 1)
    for i, r in enumerate(ROLE_ORDER):
        out = F.when(role == r, F.lit(i + 1)).otherwise(out)
    return out


def members_ordered(persons: DataFrame) -> DataFrame:
    """Members of each record in canonical order: role, age falling (nulls last), id; `position` counts from 1."""
    order = Window.partitionBy("record_id").orderBy(role_rank(F.col("role")), F.desc_nulls_last("age"), "recorded_person_id")
    return persons.withColumn("position", F.row_number().over(order))


def match_score(pairs: DataFrame) -> DataFrame:
    """Adds `score` to pairs with role_k, name_k, age_k, sex_k, source_k for k 1 and 2."""
    pairs = X.with_similarity(pairs.withColumn("_a", F.trim("name_1")).withColumn("_b", F.trim("name_2")), "_a", "_b", "_jw", NAME_THRESHOLD)
    off = F.abs(F.abs(F.col("age_2") - F.col("age_1")) - F.abs(census_year(F.col("source_2")) - census_year(F.col("source_1"))))
    set_1, set_2 = (F.coalesce(F.trim(f"sex_{k}"), F.lit("")) for k in (1, 2))
    sex = F.when((set_1 != "") & (set_2 != ""), F.when(F.upper(set_1) == F.upper(set_2), 0.2).otherwise(0.0)).when((set_1 == "") & (set_2 == ""), 0.1).otherwise(0.0)
    parts = (
        F.when(F.col("role_1").eqNullSafe(F.col("role_2")), 0.3).otherwise(0.0), F.when(F.col("_jw").isNotNull(), 0.3).otherwise(0.0),
        F.when(off <= 2, 0.2).when(off <= 5, 0.1).otherwise(0.0), sex,
    )
    return pairs.withColumn("score", F.round(sum(parts[1:], parts[0]), 6)).drop("_a", "_b", "_jw")


def member_pairs(household_pairs: DataFrame, persons: DataFrame) -> DataFrame:
    """All member pairs of household pairs (record_id_1, record_id_2), the earlier census first, with match scores."""
    rows = members_ordered(persons)
    cols = lambda k: [F.col("record_id").alias(f"record_id_{k}"), F.col("recorded_person_id").alias(f"id_{k}"), F.col("position").alias(f"position_{k}"), F.col("role").alias(f"role_{k}"), F.col("name_as_recorded").alias(f"name_{k}"), F.col("age").alias(f"age_{k}"), F.col("sex_as_recorded").alias(f"sex_{k}"), F.col("source_id").alias(f"source_{k}")]
    return match_score(household_pairs.join(rows.select(*cols(1)), "record_id_1").join(rows.select(*cols(2)), "record_id_2"))


def greedy_matches(scored: DataFrame, floor: float = MEMBER_MATCH_FLOOR) -> DataFrame:
    """One-to-one matches of each household pair: members of the first in order take their best free partner above the floor.

    Ties: the partner earlier in order. A group is the members of two households."""

    edge = F.struct("position_1", (-F.col("score")).alias("k"), "position_2", "id_1", "id_2")
    pairs = scored.filter(F.col("score") > floor).groupBy("record_id_1", "record_id_2").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    kind = "array<struct<position_1:int,k:double,position_2:int,id_1:bigint,id_2:bigint>>"
    fold = f"""aggregate(edges, cast(array() as {kind}), (done, e) -> if(exists(done, d -> d.position_1 = e.position_1 or d.position_2 = e.position_2), done,
        concat(done, array(named_struct('position_1', e.position_1, 'k', e.k, 'position_2', e.position_2, 'id_1', e.id_1, 'id_2', e.id_2)))))"""
    return pairs.select("record_id_1", "record_id_2", F.explode(F.expr(fold)).alias("d")).select("record_id_1", "record_id_2", "d.id_1", "d.id_2", (-F.col("d.k")).alias("score"))


def relationships_from_households(links: DataFrame, persons: DataFrame) -> DataFrame:
    """person_id_1, person_id_2, type: first head and first spouse a couple, both parents of sons and daughters, these siblings.

    A pair is kept once whatever its direction, as its first household has it (smallest record)."""
    rows = links.join(members_ordered(persons), "recorded_person_id").select("record_id", "person_id", "role", "position")
    first = lambda role: rows.filter(F.col("role") == role).groupBy("record_id").agg(F.min(F.struct("position", "person_id")).alias("x")).select("record_id", F.col("x.person_id").alias(role))
    head, spouse = first("head"), first("spouse")
    child = rows.filter("role in ('son', 'daughter')").select("record_id", F.col("person_id").alias("child"), F.col("position").alias("p"))
    edge = lambda df, a, b, kind: df.select("record_id", F.col(a).alias("person_id_1"), F.col(b).alias("person_id_2"), F.lit(kind).alias("type"))
    other = child.select("record_id", F.col("child").alias("child_2"), F.col("p").alias("p2"))
    found = edge(head.join(spouse, "record_id"), "head", "spouse", "couple")
    found = found.unionByName(edge(head.join(child, "record_id"), "head", "child", "parent_child")).unionByName(edge(spouse.join(child, "record_id"), "spouse", "child", "parent_child"))
    found = found.unionByName(edge(child.join(other, "record_id").filter("p < p2"), "child", "child_2", "sibling")).filter("person_id_1 <> person_id_2")
    key = found.withColumn("low", F.least("person_id_1", "person_id_2")).withColumn("high", F.greatest("person_id_1", "person_id_2"))
    once = key.groupBy("low", "high", "type").agg(F.min(F.struct("record_id", "person_id_1", "person_id_2")).alias("x"))
    return once.select("x.person_id_1", "x.person_id_2", "type")


def provenance(relationships: DataFrame, role_pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Which recorded pairs of the same type stand behind a relationship, in either direction."""
    link = lambda k: links.select(F.col("recorded_person_id").alias(f"recorded_person_id_{k}"), F.col("person_id").alias(f"p{k}"))
    seen = role_pairs.join(link(1), "recorded_person_id_1").join(link(2), "recorded_person_id_2")
    low, high = (lambda a, b: F.least(a, b).alias("low")), (lambda a, b: F.greatest(a, b).alias("high"))
    seen = seen.select(low("p1", "p2"), high("p1", "p2"), "type", "recorded_person_id_1", "recorded_person_id_2")
    rel = relationships.select("person_id_1", "person_id_2", "type", low("person_id_1", "person_id_2"), high("person_id_1", "person_id_2"))
    return rel.join(seen, ["low", "high", "type"]).select("person_id_1", "person_id_2", "type", "recorded_person_id_1", "recorded_person_id_2").distinct()


def spouse_triangulation(relationships: DataFrame) -> DataFrame:
    """anchor, spouse_1, spouse_2: two couples with the same first person, in order of their ids."""
    c = relationships.filter("type = 'couple'").select("relationship_id", F.col("person_id_1").alias("anchor"), "person_id_2")
    a, b = c.withColumnRenamed("person_id_2", "spouse_1").withColumnRenamed("relationship_id", "r1"), c.withColumnRenamed("person_id_2", "spouse_2").withColumnRenamed("relationship_id", "r2")
    return a.join(b, "anchor").filter("r1 < r2 and spouse_1 <> spouse_2").select("anchor", "spouse_1", "spouse_2")


def resolve_relationships(household_pairs: DataFrame, persons: DataFrame, links: DataFrame, threshold: float = AUTO_COMMIT_THRESHOLD, conflict: str = "overwrite") -> DataFrame:
    """Links after the members of similar households have been linked, household pairs in falling score.

    Household pairs (record_id_1, record_id_2, score) of one component depend on each other, and are folded in
    order; components are independent. A match links its second recorded person to the first one's person
    (else the reverse, else a new one), unless the person has one of that source already or the ages do not
    fit. An orphan is linked; one with another person is moved (`overwrite`) or left (`keep_existing`)."""
    from .cluster import connected_components, held

    good = household_pairs.filter(F.col("score") >= threshold)
    matches = greedy_matches(member_pairs(good.select("record_id_1", "record_id_2"), persons))
    matches = matches.withColumnRenamed("score", "match").join(good, ["record_id_1", "record_id_2"])
    info = lambda k: persons.select(F.col("recorded_person_id").alias(f"id_{k}"), F.col("age").alias(f"age_{k}"), F.col("source_id").alias(f"source_{k}"))
    rows = matches.join(info(1), "id_1").join(info(2), "id_2")
    rows = rows.withColumn("ages", age_valid(F.col("age_1"), F.col("source_1"), F.col("age_2"), F.col("source_2")))
    rows = held(rows.select("score", "match", "record_id_1", "record_id_2", "id_1", "id_2", "source_1", "source_2", "ages"))
    # matches that meet in a person, directly or through links, are one component; links of persons without a match stay out of it
    node = F.col("person_id") * -1 - 1
    several = links.groupBy("recorded_person_id").agg(F.min("person_id").alias("p"), F.max("person_id").alias("q")).filter("p <> q").select("recorded_person_id")
    ties = links.join(several, "recorded_person_id").select(F.col("recorded_person_id").alias("a"), node.alias("b"))
    ends = rows.select(F.explode(F.array("id_1", "id_2")).alias("recorded_person_id")).distinct()
    ends = ends.join(links, "recorded_person_id").select(F.col("recorded_person_id").alias("a"), node.alias("b"))
    part = held(connected_components(rows.select(F.col("id_1").alias("a"), F.col("id_2").alias("b")).unionByName(ends).unionByName(ties), "a", "b"))
    todo = rows.join(part, F.col("id_1") == F.col("node")).drop("node")
    touched = held(todo.select(F.col("component").alias("part")).distinct().join(part, F.col("part") == F.col("component")).filter("node < 0").select("part", (-F.col("node") - 1).alias("person_id")))
    known = links.join(touched, "person_id").join(persons.select("recorded_person_id", "source_id"), "recorded_person_id", "left").select("part", "person_id", "recorded_person_id", F.col("score").alias("link_score"), "source_id")

    def fold(key, matched: pd.DataFrame, linked: pd.DataFrame) -> pd.DataFrame:
        of = {r.recorded_person_id: (r.person_id, r.link_score) for r in linked.itertuples()}
        source = {r.recorded_person_id: r.source_id for r in linked.itertuples()}
        source |= dict(zip(matched["id_1"], matched["source_1"], strict=True)) | dict(zip(matched["id_2"], matched["source_2"], strict=True))
        members: dict[int, set[int]] = {}
        for rp, (p, _) in of.items():
            members.setdefault(p, set()).add(rp)

        def put(rp, person, score):
            if any(source[x] == source[rp] and x != rp for x in members.get(person, ())):
                return
            if rp in of:
                if of[rp][0] == person or conflict != "overwrite":
                    return
                members[of[rp][0]].discard(rp)
            of[rp] = (person, score)
            members.setdefault(person, set()).add(rp)

        for r in matched.sort_values(["score", "record_id_1", "record_id_2", "id_1", "id_2"], ascending=[False, True, True, True, True]).itertuples():
            person = of[r.id_1][0] if r.id_1 in of else of[r.id_2][0] if r.id_2 in of else min(r.id_1, r.id_2)
            for rp in (r.id_1, r.id_2):
                if r.ages or rp not in (r.id_2,):
                    put(rp, person, r.match)
        return pd.DataFrame([(p, rp, float(s)) for rp, (p, s) in of.items()], columns=["person_id", "recorded_person_id", "score"])

    folded = todo.groupBy("component").cogroup(known.groupBy("part")).applyInPandas(fold, "person_id long, recorded_person_id long, score double")
    rest = links.join(touched, "person_id", "left_anti").select("person_id", "recorded_person_id", "score")
    return folded.unionByName(rest)


def extend_households(links: DataFrame, persons: DataFrame, related: DataFrame, default: float = 0.75) -> DataFrame:
    """New links: an unlinked member with a recorded pair to an anchor of its record gets a person of its own.

    `related` has recorded_person_id_1, recorded_person_id_2, score. Members go in canonical order, and one that
    gets a person is an anchor for the next. Anchors are all recorded persons of persons anchored in the record.
    A group is one record."""
    rows = members_ordered(persons).select("record_id", "recorded_person_id", "position").join(links.select("recorded_person_id", "person_id"), "recorded_person_id", "left")
    homes = rows.groupBy("record_id").agg(F.count("person_id").alias("k"), F.count(F.lit(1)).alias("n")).filter("k > 0 and k < n").select("record_id")
    rows = rows.join(homes, "record_id")
    anchors = rows.filter("person_id is not null").select("record_id", "person_id").distinct().join(links.select("person_id", F.col("recorded_person_id").alias("anchor")), "person_id").select("record_id", "anchor").distinct()
    both = related.select(F.col("recorded_person_id_1").alias("u"), F.col("recorded_person_id_2").alias("v"), "score")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "score"))
    todo = rows.filter("person_id is null").select("record_id", "recorded_person_id", "position")
    reach = todo.join(both, F.col("recorded_person_id") == F.col("u")).select("record_id", "recorded_person_id", "position", "v", F.coalesce("score", F.lit(default)).alias("score"))
    reach = reach.join(anchors.select("record_id", F.col("anchor").alias("v"), F.lit(True).alias("anchored")), ["record_id", "v"], "left")
    inside = todo.select("record_id", F.col("recorded_person_id").alias("v"), F.lit(True).alias("mate"))
    reach = reach.join(inside, ["record_id", "v"], "left").filter("anchored or mate")

    edge = F.struct("position", F.col("recorded_person_id").alias("rp"), (-F.col("score")).alias("k"), "v", F.coalesce("anchored", F.lit(False)).alias("anchored"))
    homes = reach.groupBy("record_id").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    fold = """aggregate(edges, cast(array() as array<struct<rp:bigint,k:double>>), (done, e) -> if(not exists(done, d -> d.rp = e.rp) and (e.anchored or exists(done, d -> d.rp = e.v)),
        concat(done, array(named_struct('rp', e.rp, 'k', e.k))), done))"""
    new = homes.select(F.explode(F.expr(fold)).alias("d"))
    return new.select(F.col("d.rp").alias("person_id"), F.col("d.rp").alias("recorded_person_id"), (-F.col("d.k")).alias("score"))


def orphans(persons: DataFrame, links: DataFrame) -> DataFrame:
    """Persons without a recorded person; their rows go from every table that names them (see without_persons)."""
    return persons.join(links.select("person_id").distinct(), "person_id", "left_anti")


def without_persons(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of persons that go, by person_id or by either person of a pair."""
    ids = gone.select("person_id").distinct()
    out = {}
    for name, df in tables.items():
        for c in [c for c in ("person_id", "person_id_1", "person_id_2") if c in df.columns]:
            df = df.join(ids.withColumnRenamed("person_id", c), c, "left_anti")
        out[name] = df.select(*tables[name].columns)
    return out


__all__ = ["describe", "extend_households", "greedy_matches", "match_score", "member_pairs", "members_ordered", "orphans", "provenance", "relationships_from_households", "resolve_relationships", "role_rank", "spouse_triangulation", "without_persons"]
