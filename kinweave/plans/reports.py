"""Reporting and browsing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.groupBy().agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def composition(rows: DataFrame) -> DataFrame:
    """Records and persons of each census, and its share of all persons."""
    per = rows.groupBy("source_id").agg(F.countDistinct("record_id").alias("records"), F.count(F.lit(1)).alias("persons"))
    return per.withColumn("pct", F.round(100 * F.col("persons") / F.sum("persons").over(Window.partitionBy(F.lit(1))), 4))


def linked_share(rows: DataFrame, links: DataFrame) -> DataFrame:
    both = rows.select("recorded_person_id").join(links.select("recorded_person_id", F.lit(1).alias("k")).distinct(), "recorded_person_id", "left")
    return both.agg(F.count(F.lit(1)).alias("persons"), F.count("k").alias("linked"), F.round(100 * F.count("k") / F.count(F.lit(1)), 4).alias("pct"))


def census_coverage(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Number of persons by how many censuses they are in."""
    n = links.join(rows.select("recorded_person_id", "source_id"), "recorded_person_id").groupBy("person_id").agg(F.countDistinct("source_id").alias("censuses"))
    return n.groupBy("censuses").agg(F.count(F.lit(1)).alias("persons"))


def pairwise_linkage(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Persons in both of two censuses."""
    has = links.join(rows.select("recorded_person_id", "source_id"), "recorded_person_id").groupBy("person_id").pivot("source_id", [3, 4, 5]).agg(F.count(F.lit(1)))
    both = lambda a, b: F.count_if(F.col(str(a)).isNotNull() & F.col(str(b)).isNotNull()).alias(f"n_{a}_{b}")
    return has.agg(both(3, 4), both(4, 5), both(3, 5))


def score_tiers(similarity: DataFrame) -> DataFrame:
    tier = lambda a, b: F.count_if((F.col("score") >= a) & (F.col("score") < b))
    return similarity.agg(
        F.count(F.lit(1)).alias("n"), tier(0.85, 2).alias("high"), tier(0.65, 0.85).alias("good"), tier(0.45, 0.65).alias("fair"), tier(0.3, 0.45).alias("weak"),
        F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev("score"), 6).alias("sd"), F.min("score").alias("low"), F.max("score").alias("top"),
    )


def validation_export(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Each recorded person with its turn in the record and the dates of the other censuses its person is in."""
    turn = F.row_number().over(Window.partitionBy("record_id").orderBy("recorded_person_id"))
    at = links.select("person_id", "recorded_person_id").join(rows.select("recorded_person_id", "date"), "recorded_person_id")
    other = at.select("person_id", F.col("recorded_person_id").alias("rp2"), F.col("date").alias("date2"))
    far = at.join(other, "person_id").filter("recorded_person_id <> rp2").groupBy("recorded_person_id").agg(F.expr("listagg(DISTINCT date2, ', ') WITHIN GROUP (ORDER BY date2)").alias("linked_to_years"))
    return rows.select("recorded_person_id", "record_id", turn.alias("person_no"), F.col("date").alias("census_year"), "name_as_recorded", "role", "age").join(far, "recorded_person_id", "left")


def person_browser(persons: DataFrame, rows: DataFrame, links: DataFrame, status: str | None = None, townland: str | None = None, least_coverage: int = 0) -> DataFrame:
    """persons with counts, censuses, weakest link, places and score band; filters are added where given."""
    at = links.join(rows.select("recorded_person_id", "source_id", F.substring("date", 1, 4).alias("year"), "place_as_recorded"), "recorded_person_id")
    agg = at.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n_recorded"), F.countDistinct("source_id").alias("n_censuses"), F.array_join(F.array_sort(F.collect_set("year")), ", ").alias("censuses"),
        F.min("score").alias("weakest"), F.array_join(F.array_sort(F.collect_set("place_as_recorded")), ", ").alias("places"),
    )
    out = persons.join(agg, "person_id").withColumn("band", F.when(F.col("weakest") >= 0.80, "strong").when(F.col("weakest") >= 0.60, "fair").otherwise("weak"))
    if status:
        out = out.filter(F.col("status") == status)
    if townland:
        out = out.filter(F.lower("places").contains(townland.lower()))
    return out.filter(F.col("n_censuses") >= least_coverage)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def person_detail(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Recorded rows of each person by census."""
    return links.join(rows, "recorded_person_id").select("person_id", "recorded_person_id", "record_id", "source_id", "date", "name_as_recorded", "age", "role", "place_as_recorded", "score")


def co_members(rows: DataFrame, links: DataFrame) -> DataFrame:
    """For each person the other members of its records."""
    own = links.join(rows.select("recorded_person_id", "record_id"), "recorded_person_id").select("person_id", F.col("recorded_person_id").alias("own"), "record_id")
    return own.join(rows.select("record_id", "recorded_person_id", "name_as_recorded", "role"), "record_id").filter("own <> recorded_person_id").select("person_id", "record_id", "recorded_person_id", "name_as_recorded", "role")


def year_pair_scores(similarity: DataFrame, rows: DataFrame, links: DataFrame) -> DataFrame:
    """Best similarity between a person's recorded rows by pair of censuses."""
    side = lambda k: links.select("person_id", "recorded_person_id").join(rows.select("recorded_person_id", F.substring("date", 1, 4).alias("y")), "recorded_person_id").select(F.col("recorded_person_id").alias(f"id_{k}"), F.col("person_id").alias(f"p{k}"), F.col("y").alias(f"y{k}"))
    both = similarity.join(side(1), "id_1").join(side(2), "id_2").filter("p1 = p2")
    return both.groupBy(F.col("p1").alias("person_id"), F.concat(F.least("y1", "y2"), F.lit("-"), F.greatest("y1", "y2")).alias("years")).agg(F.max("score").alias("best"))


def name_search(persons: DataFrame, text: str, limit: int = 20) -> DataFrame:
    return persons.filter(F.col("label").ilike(f"%{text}%")).orderBy("label", "person_id").limit(limit)


def timing_report(runs: DataFrame) -> DataFrame:
    """Runs by stage and step: n, total, mean, least and most seconds."""
    return runs.groupBy("stage", "step").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 4).alias("total"), F.round(F.avg("seconds"), 4).alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("start_at"), F.desc("run_id")).limit(limit)


def derived_confidence(links: DataFrame) -> DataFrame:
    """Band of a person by its number of recorded rows: one low, two medium, more high."""
    n = links.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("confidence", F.when(F.col("n") >= 3, "high").when(F.col("n") == 2, "medium").otherwise("low"))


def persons_spanning(persons: DataFrame, rows: DataFrame, links: DataFrame, least: int = 2) -> DataFrame:
    """Persons found in at least so many censuses."""
    at = links.join(rows.select("recorded_person_id", "source_id"), "recorded_person_id").groupBy("person_id").agg(F.countDistinct("source_id").alias("censuses"))
    return at.filter(F.col("censuses") >= least).join(persons.select("person_id", "label"), "person_id")


def score_bands(links: DataFrame) -> DataFrame:
    """Links by band of score, with the share that is verified; `links` has a boolean `verified`."""
    band = F.when(F.col("score") >= 0.85, "high").when(F.col("score") >= 0.60, "medium").when(F.col("score") >= 0.30, "low").otherwise("below_floor")
    return links.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if("verified") / F.count(F.lit(1)), 6).alias("verified_share"))


def unverified_high(persons: DataFrame, rows: DataFrame, links: DataFrame, least: float = 0.85) -> DataFrame:
    """Links of a high score that nobody has verified, for review."""
    todo = links.filter((F.col("score") >= least) & ~F.coalesce("verified", F.lit(False)))
    todo = todo.join(rows.select("recorded_person_id", "record_id", "source_id"), "recorded_person_id").join(persons.select("person_id", "label"), "person_id")
    return todo.select("person_id", "label", "recorded_person_id", "record_id", "source_id", "score")


def top_similar(similarity: DataFrame, k: int = 3) -> DataFrame:
    """The k best partners of each recorded person, in either direction; ties: the smaller id."""
    ways = F.array(F.struct(F.col("id_1").alias("id"), F.col("id_2").alias("other")), F.struct(F.col("id_2").alias("id"), F.col("id_1").alias("other")))
    both = similarity.select(F.explode(ways).alias("w"), "score").select("w.id", "w.other", "score")
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other")).cast("long")
    return both.withColumn("turn", turn).filter(F.col("turn") <= k)


def unscored_records(records: DataFrame, rows: DataFrame, similarity: DataFrame) -> DataFrame:
    """Records by census of which no person has been scored yet: what is left for the next run."""
    scored = similarity.select(F.explode(F.array("id_1", "id_2")).alias("recorded_person_id")).distinct()
    seen = rows.select("recorded_person_id", "record_id").join(scored, "recorded_person_id", "left_semi").select("record_id").distinct()
    return records.join(seen, "record_id", "left_anti").groupBy("source_id").agg(F.count(F.lit(1)).alias("records"))


def top_surnames(rows: DataFrame, k: int = 20) -> DataFrame:
    return rows.groupBy(X.surname_of(F.col("name_as_recorded")).alias("surname")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "surname").limit(k)


def sexes(rows: DataFrame) -> DataFrame:
    """Recorded persons by census and recorded sex."""
    return rows.groupBy("source_id", "sex_as_recorded").agg(F.count(F.lit(1)).alias("n"))


def same_name_pairs(rows: DataFrame, slack: int = 1) -> DataFrame:
    """Equally named persons of two censuses whose birth years differ by at most `slack`, counted by pair of censuses.

    Pairs are products of counts and never made, so a frequent name costs a row per birth year."""
    n = rows.filter("birth_year is not null").groupBy(X.norm(F.col("name_as_recorded")).alias("name"), "birth_year", "source_id").agg(F.count(F.lit(1)).alias("n"))
    years = F.explode(F.sequence(F.col("birth_year") - slack, F.col("birth_year") + slack)).alias("birth_year")
    near = n.select("name", F.col("source_id").alias("source_2"), F.col("n").alias("m"), years)
    both = n.withColumnRenamed("source_id", "source_1").join(near, ["name", "birth_year"]).filter("source_1 < source_2")
    return both.groupBy("source_1", "source_2").agg(F.sum(F.col("n") * F.col("m")).alias("pairs"))


def born_abroad(rows: DataFrame, column: str, pattern: str = "America|England|Scotland") -> DataFrame:
    """Persons by census, and how many have a place in `column` that matches `pattern`."""
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(column).rlike(pattern)).alias("abroad"))
