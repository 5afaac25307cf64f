"""Life events from linked evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BIRTH_BUCKET
from ..functions import text as X


def census_events(links: DataFrame, persons: DataFrame) -> DataFrame:
    """One event per record with a linked person: record_id, date, place_id, persons."""
    rows = links.join(persons, "recorded_person_id")
    return rows.groupBy("record_id", "date", "place_id").agg(F.countDistinct("person_id").alias("persons")).select("record_id", F.lit("census").alias("type"), "date", "place_id", "persons")


def birth_buckets(links: DataFrame, persons: DataFrame, width: int = BIRTH_BUCKET) -> DataFrame:
    """person_id, bucket, votes, is_primary: sorted birth years fall into the first bucket within `width` of its first year.

    A person has a few years, so the fold runs inside one row. Primary: most votes, then the earliest."""
    rows = links.join(persons.select("recorded_person_id", "birth_year"), "recorded_person_id").filter("birth_year is not null")
    years = rows.groupBy("person_id").agg(F.array_sort(F.collect_list("birth_year")).alias("years"))
    # years are sorted, so only the last bucket can still be within reach
    fold = f"""aggregate(years, cast(array() as array<struct<y:int,n:int>>), (b, y) ->
        if(size(b) > 0 and y - element_at(b, -1).y <= {width},
           concat(slice(b, 1, size(b) - 1), array(named_struct('y', element_at(b, -1).y, 'n', element_at(b, -1).n + 1))),
           concat(b, array(named_struct('y', cast(y as int), 'n', 1)))))"""
    one = years.select("person_id", F.explode(F.expr(fold)).alias("b")).select("person_id", F.col("b.y").alias("bucket"), F.col("b.n").alias("votes"))
    best = Window.partitionBy("person_id").orderBy(F.desc("votes"), "bucket")
    return one.withColumn("is_primary", (F.row_number().over(best) == 1).cast("int"))


def birth_events(links: DataFrame, persons: DataFrame) -> DataFrame:
    """Birth events with date and modal place of the bucket's records."""
    buckets = birth_buckets(links, persons)
    rows = links.join(persons.select("recorded_person_id", "birth_year", "place_id"), "recorded_person_id").filter("birth_year is not null")
    near = rows.join(buckets, "person_id").filter(F.col("birth_year").between(F.col("bucket"), F.col("bucket") + BIRTH_BUCKET))
    counts = near.filter("place_id is not null").groupBy("person_id", "bucket", "place_id").count()
    place = counts.groupBy("person_id", "bucket").agg(F.min(F.struct((-F.col("count")).alias("n"), "place_id")).alias("m")).select("person_id", "bucket", F.col("m.place_id").alias("place_id"))
    return buckets.join(place, ["person_id", "bucket"], "left").select("person_id", F.lit("birth").alias("type"), F.concat(F.col("bucket").cast("string"), F.lit("-01-01")).alias("date"), F.lit("calculated").alias("date_qualifier"), "is_primary", "place_id", "votes")


def marriage_events(relationships: DataFrame, links: DataFrame, persons: DataFrame) -> DataFrame:
    """One undated marriage per couple, with the records that show both."""
    couples = relationships.filter("type = 'couple'").select(F.least("person_id_1", "person_id_2").alias("p1"), F.greatest("person_id_1", "person_id_2").alias("p2")).distinct()
    at = links.join(persons.select("recorded_person_id", "record_id"), "recorded_person_id").select("person_id", "record_id").distinct()
    both = couples.join(at.select(F.col("person_id").alias("p1"), "record_id"), "p1").join(at.select(F.col("person_id").alias("p2"), F.col("record_id").alias("r2")), "p2").filter("record_id = r2")
    shown = both.groupBy("p1", "p2").agg(F.array_sort(F.collect_set("record_id")).alias("record_ids"))
    return couples.join(shown, ["p1", "p2"], "left").select(F.col("p1").alias("person_id_1"), F.col("p2").alias("person_id_2"), F.lit("marriage").alias("type"), F.lit(None).cast("string").alias("date"), F.coalesce(F.size("record_ids"), F.lit(0)).alias("records"), "record_ids")


def vote_counts(events: DataFrame, records: DataFrame) -> DataFrame:
    """Records behind each event, and its rank within person and type; ties: the smaller id."""
    n = events.join(records.groupBy("event_id").agg(F.countDistinct("record_id").alias("votes")), "event_id", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("person_id", "type").orderBy(F.desc("votes"), "event_id")))


def derived_years(events: DataFrame, links: DataFrame, persons: DataFrame) -> DataFrame:
    """person_id, birth_year, death_year for all persons at once.

    Birth: primary birth, else primary baptism, else the census year less the lowest age; death: primary death.
    Of several primaries the smallest event id counts."""
    first = lambda kind, name: events.filter((F.col("type") == kind) & (F.col("is_primary") == 1)).groupBy("person_id").agg(F.min_by(X.year_of(F.col("date")), "event_id").alias(name))
    rows = links.join(persons.select("recorded_person_id", "age", "date"), "recorded_person_id").filter("age is not null")
    census = rows.groupBy("person_id").agg(F.min(F.struct("age", (X.year_of(F.col("date"))).alias("y"))).alias("m")).select("person_id", (F.col("m.y") - F.col("m.age")).alias("census_birth"))
    everyone = links.select("person_id").distinct()
    out = everyone.join(first("birth", "b1"), "person_id", "left").join(first("baptism", "b2"), "person_id", "left").join(census, "person_id", "left").join(first("death", "death_year"), "person_id", "left")
    return out.select("person_id", F.coalesce("b1", "b2", "census_birth").alias("birth_year"), "death_year")
