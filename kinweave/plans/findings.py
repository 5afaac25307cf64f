"""Review findings: each a read-only query with the same columns, ranked together."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FATHER_MAX, FINDING_BASE, FINDING_DEFAULT, LIFESPAN_TOLERANCE, LIVING_EVENTS, MARRIAGE_MIN, MARRIAGE_TOLERANCE, MOTHER_MAX, PARENT_MIN, PARENT_TOLERANCE, SCOPE_WEIGHT, SEQUENCE_TOLERANCE, WEAK_SIMILARITY
from ..functions import text as X
from ..operators.cluster import held

COLUMNS = "finding_type string, person_id long, relationship_id long, event_id long, record_ids array<bigint>, title string, detail string, recommended_action string"
#: What orders findings of one score and type.
TIES = ["person_id", "record_ids", "event_id", "relationship_id", "title"]


def finding(df: DataFrame, kind: str, title: Column, action: str, person="person_id", relationship=None, event=None, records=None, detail: Column | None = None) -> DataFrame:
    """A finding's rows in the common columns."""
    col = lambda c, t: (F.col(c) if c else F.lit(None)).cast(t)
    return df.select(
        F.lit(kind).alias("finding_type"), col(person, "long").alias("person_id"), col(relationship, "long").alias("relationship_id"), col(event, "long").alias("event_id"),
        (F.col(records) if records else F.array()).cast("array<bigint>").alias("record_ids"), title.alias("title"), (detail if detail is not None else title).alias("detail"), F.lit(action).alias("recommended_action"),
    )


def _ids(c: str) -> Column:
    return F.array_sort(F.collect_set(c))


def merge_errors(persons: DataFrame, links: DataFrame, rows: DataFrame) -> DataFrame:
    """Active persons with more than one record in a census: person_id, source_id, n, record_ids."""
    at = links.join(persons.filter("status = 'active'").select("person_id"), "person_id").join(rows.select("recorded_person_id", "record_id", "source_id"), "recorded_person_id")
    return at.groupBy("person_id", "source_id").agg(F.countDistinct("record_id").alias("n"), _ids("record_id").alias("record_ids")).filter("n > 1")


def event_singularity(persons: DataFrame, events: DataFrame, kind: str) -> DataFrame:
    """Active persons with more than one primary event of a kind: person_id, n, event_ids."""
    e = events.filter((F.col("type") == kind) & (F.col("is_primary") == 1)).join(persons.filter("status = 'active'").select("person_id"), "person_id", "left_semi")
    return e.groupBy("person_id").agg(F.countDistinct("event_id").alias("n"), _ids("event_id").alias("event_ids")).filter("n > 1")


def event_sequence(persons: DataFrame, events: DataFrame, slack: int = SEQUENCE_TOLERANCE) -> DataFrame:
    """person_id and n of its events out of order: before birth, burial before death, living after death."""
    e = events.join(persons.filter("status = 'active'").select("person_id"), "person_id", "left_semi").select("person_id", "event_id", "type", X.year_of(F.col("date")).alias("y")).filter("y is not null")
    low = lambda t: F.min(F.when(F.col("type") == t, F.col("y")))
    first = e.groupBy("person_id").agg(low("birth").alias("birth"), low("baptism").alias("baptism"), low("death").alias("death"), low("burial").alias("burial"))
    early = (F.col("type").isin("birth", "baptism") == F.lit(False)) & (F.col("y") < F.col("birth") - slack)
    late = F.col("type").isin(*LIVING_EVENTS) & (F.col("y") > F.col("death") + slack)
    per = e.join(first, "person_id").groupBy("person_id").agg((F.count_if(early) + F.count_if(late)).alias("events"))
    once = F.coalesce((F.col("baptism") < F.col("birth") - slack).cast("int"), F.lit(0)) + F.coalesce((F.col("burial") < F.col("death") - slack).cast("int"), F.lit(0))
    return per.join(first, "person_id").select("person_id", (F.col("events") + once).cast("long").alias("n")).filter("n > 0")


def parent_gaps(relationships: DataFrame, persons: DataFrame, years: DataFrame) -> DataFrame:
    """relationship_id, parent, child, gap in years, parent's gender, over parent_child rows."""
    y = lambda k: years.select(F.col("person_id").alias(f"person_id_{k}"), F.col("birth_year").alias(f"b{k}"))
    g = persons.select(F.col("person_id").alias("person_id_1"), "gender")
    r = relationships.filter("type = 'parent_child'").join(y(1), "person_id_1").join(y(2), "person_id_2").join(g, "person_id_1")
    return r.select("relationship_id", F.col("person_id_1").alias("parent"), F.col("person_id_2").alias("child"), (F.col("b2") - F.col("b1")).alias("gap"), "gender").filter("gap is not null")


def parent_age(gaps: DataFrame) -> DataFrame:
    """Gaps that are impossible (parent younger) or implausible: adds kind."""
    t = PARENT_TOLERANCE
    g, sex = F.col("gap"), F.col("gender")
    kind = F.when(g < 0, "parent_age_regression").when((g + t < PARENT_MIN) | ((sex == "F") & (g - t > MOTHER_MAX)) | ((sex == "M") & (g - t > FATHER_MAX)), "parent_age_implausible")
    return gaps.withColumn("kind", kind).filter("kind is not null")


def split_persons(gaps: DataFrame) -> DataFrame:
    """Mothers with two or more children over the largest plausible gap."""
    return gaps.filter((F.col("gender") == "F") & (F.col("gap") > MOTHER_MAX)).groupBy(F.col("parent").alias("person_id")).agg(F.countDistinct("child").alias("n"), _ids("child").alias("children")).filter("n >= 2")


def marriage_age(events: DataFrame, years: DataFrame) -> DataFrame:
    """Marriages at an age under the least: event_id, person_id, age."""
    m = events.filter("type = 'marriage'").select("event_id", "person_id", X.year_of(F.col("date")).alias("y")).join(years, "person_id")
    return m.select("event_id", "person_id", (F.col("y") - F.col("birth_year")).alias("age")).filter(F.col("age") + MARRIAGE_TOLERANCE < MARRIAGE_MIN)


def lifespan(persons: DataFrame, links: DataFrame, rows: DataFrame, years: DataFrame, slack: int = LIFESPAN_TOLERANCE) -> DataFrame:
    """Records of active persons before birth or after death: person_id, n, record_ids."""
    at = links.join(persons.filter("status = 'active'").select("person_id"), "person_id", "left_semi").join(rows.select("recorded_person_id", "record_id", X.year_of(F.col("date")).alias("y")), "recorded_person_id").join(years, "person_id")
    bad = at.filter((F.col("y") < F.col("birth_year") - slack) | (F.col("y") > F.col("death_year") + slack))
    return bad.groupBy("person_id").agg(F.countDistinct("record_id").alias("n"), _ids("record_id").alias("record_ids"))


def unlinked(rows: DataFrame, links: DataFrame) -> DataFrame:
    return rows.join(links.select("recorded_person_id"), "recorded_person_id", "left_anti")


def single_census(persons: DataFrame, links: DataFrame, rows: DataFrame, events: DataFrame) -> DataFrame:
    """Active persons in exactly one census and without a death."""
    at = links.join(rows.select("recorded_person_id", "source_id", "record_id"), "recorded_person_id")
    one = at.groupBy("person_id").agg(F.countDistinct("source_id").alias("sources"), F.min("source_id").alias("source_id"), _ids("record_id").alias("record_ids")).filter("sources = 1")
    alive = persons.filter("status = 'active'").join(events.filter("type = 'death'").select("person_id"), "person_id", "left_anti")
    return one.join(alive.select("person_id"), "person_id", "left_semi").select("person_id", "source_id", "record_ids")


def mixed_households(rows: DataFrame, links: DataFrame, similarity: DataFrame, weak: float = WEAK_SIMILARITY) -> DataFrame:
    """Unlinked members of records with linked ones: record_id, recorded_person_id, best weak score (null: isolated).

    Both ends of a pair are one long table, so that the join is on equal ids."""
    at = rows.select("record_id", "recorded_person_id").join(links.select("recorded_person_id", F.lit(1).alias("linked")).distinct(), "recorded_person_id", "left")
    homes = at.groupBy("record_id").agg(F.count_if(F.col("linked").isNotNull()).alias("k"), F.count_if(F.col("linked").isNull()).alias("u")).filter("k > 0 and u > 0")
    low = similarity.filter(F.col("score") < weak)
    ends = low.select(F.explode(F.array("id_1", "id_2")).alias("recorded_person_id"), "score").groupBy("recorded_person_id").agg(F.max("score").alias("best_weak_score"))
    return at.filter("linked is null").join(homes, "record_id", "left_semi").join(ends, "recorded_person_id", "left").select("record_id", "recorded_person_id", "best_weak_score")


def link_conflicts(spark) -> DataFrame:
    """Conflicts resolved are not recorded yet: no rows."""
    return spark.createDataFrame([], COLUMNS)


def all_findings(persons: DataFrame, links: DataFrame, rows: DataFrame, events: DataFrame, relationships: DataFrame, similarity: DataFrame, years: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every finding in the common columns.

    With `columns`, only these, and each finding is run and held by itself: as one query the plans of all of them, a dozen joins
    each, meet in the driver."""
    n = lambda text: F.concat(F.lit("Person "), F.col("person_id"), F.lit(f": {text} ("), F.col("n"), F.lit(")"))
    gaps = parent_age(parent_gaps(relationships, persons, years))
    gap = F.concat(F.lit("Parent "), F.col("parent"), F.lit(" and child "), F.col("child"), F.lit(": gap "), F.col("gap"))
    lone = F.concat(F.lit("Recorded person "), F.col("recorded_person_id"), F.lit(" has no person"))
    parts = [
        finding(merge_errors(persons, links, rows), "merge_error_candidate", n("several records in one census"), "Check for a merge error.", records="record_ids"),
        *[finding(event_singularity(persons, events, k), f"{k}_singularity_violation", n(f"several primary {k} events"), "Choose one primary event.") for k in ("birth", "death")],
        finding(event_sequence(persons, events), "life_event_sequence_violation", n("events out of order"), "Review the dates."),
        *[finding(gaps.filter(F.col("kind") == k), k, gap, "Review the relationship.", person="parent", relationship="relationship_id") for k in ("parent_age_regression", "parent_age_implausible")],
        finding(split_persons(parent_gaps(relationships, persons, years)), "split_person_candidate", n("children too far apart"), "Check whether this is two persons."),
        finding(marriage_age(events, years), "marriage_age_implausible", F.concat(F.lit("Person "), F.col("person_id"), F.lit(": married at "), F.col("age")), "Review the marriage.", event="event_id"),
        finding(lifespan(persons, links, rows, years), "lifespan_boundary_violated", n("records outside the lifespan"), "Review the records.", records="record_ids"),
        finding(unlinked(rows, links).withColumn("ids", F.array("record_id")), "unlinked_recorded_person", lone, "Look for a match.", person=None, records="ids"),
        finding(single_census(persons, links, rows, events), "single_census_appearance", F.concat(F.lit("Person "), F.col("person_id"), F.lit(": one census only")), "Look in the other censuses.", records="record_ids"),
        finding(mixed_households(rows, links, similarity).withColumn("ids", F.array("record_id")), "unlinked_in_populated_household", F.concat(lone, F.lit(" beside linked members")), "Compare with the household's persons.", person=None, records="ids"),
    ]
    if columns:
        parts = [held(p.select(*columns)) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prioritise(found: DataFrame, links: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds raw_score (base of the type, less for persons in several censuses) and rank 1..N; ties by type, person, record, title.

    Ranks are one order over all findings: a range sort, its partitions' sizes, and a rank within each."""
    scope = links.join(rows.select("recorded_person_id", "source_id"), "recorded_person_id").groupBy("person_id").agg(F.countDistinct("source_id").alias("sources"))
    base, weight = F.lit(float(FINDING_DEFAULT)), F.lit(1.0)
    for k, v in FINDING_BASE.items():
        base = F.when(F.col("finding_type") == k, F.lit(float(v))).otherwise(base)
    for k, v in SCOPE_WEIGHT.items():
        weight = F.when((F.col("sources") >= k) if k == max(SCOPE_WEIGHT) else (F.col("sources") == k), F.lit(v)).otherwise(weight)
    scored = found.join(scope, "person_id", "left").withColumn("raw_score", F.round(base * weight, 6)).drop("sources")
    return ranked(scored, ["raw_score", "finding_type", *TIES], "priority")


def ranked(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds a rank 1..N over all rows without gathering them in one task."""
    spread = df.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id())
    spread = held(spread)
    sizes = {r["_p"]: r["count"] for r in spread.groupBy("_p").count().collect()}
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    table = spread.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "_p int, _start long")
    w = Window.partitionBy("_p").orderBy(*keys)
    return spread.join(F.broadcast(table), "_p").withColumn(name, F.col("_start") + F.row_number().over(w)).drop("_p", "_start")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("finding_type").agg(F.count(F.lit(1)).alias("n"))


def write_report(ranked_findings: DataFrame, folder: str) -> tuple[str, str]:
    """A JSON and a Markdown report with one time stamp, streamed row by row; a report is read by people."""
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    counts = {r["finding_type"]: r["n"] for r in summary(ranked_findings).collect()}
    paths = f"{folder}/review_{stamp}.json", f"{folder}/review_{stamp}.md"
    with open(paths[0], "w") as js, open(paths[1], "w") as md:
        md.write("# Review\n\n" + "".join(f"* {k}: {v}\n" for k, v in sorted(counts.items())))
        js.write(json.dumps({"summary": counts, "findings": []})[:-2])
        for i, r in enumerate(ranked_findings.orderBy("priority").toLocalIterator()):
            js.write(("," if i else "") + json.dumps(r.asDict(), default=str))
            md.write(f"\n## {r['priority']}. {r['title']}\n\n{r['detail']}\n\n{r['recommended_action']}\n")
        js.write("]}")
    return paths
