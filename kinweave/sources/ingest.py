"""CSV sources and sinks: census extracts, the place authority, exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CENSUS_DATE
from ..functions import text as X

# Headers of the extracts.
_EARLY = "id census_year county surname firstname townland townland_clean ded age sex house_number relation_to_head religion education occupation marriage_status {} birthplace language deafdumb image_group religion_updated occupation_updated relation_to_head_updated language_updated images ded_clean"
HEADERS = {
    3: _EARLY.format("").split(),
    4: _EARLY.format("marriage_years children_born children_living").split(),
    5: "aform_name county townland ded first_name surname relationship_to_head updated_relationship_to_head updated_sex updated_marriage updated_irish_language updated_religion years_married irish_or_english birthplace_county children_born_alive children_living updated_age geocode institution_name institution_type image_group a_id".split(),
}
# Place types of the authority file.
PLACE_HEADER = "place_id logainm_id name_en place_type parent_name parent_id parent_type ded_name ded_id county_name county_id barony_name barony_id civil_parish_name civil_parish_id latitude longitude logainm_url notes".split()
PLACE_TYPE = {
    "barony": "barony", "civil parish": "civil_parish", "county": "county", "ded": "ded", "electoral division": "ded",
    "province": "province", "town": "town", "townland": "townland", "civil_parish": "civil_parish", "church_parish": "church_parish",
}


class HeaderError(ValueError):
    """A file's columns are not those of its source."""


def read_census(spark: SparkSession, path: str, source_id: int) -> DataFrame:
    """Rows of an extract as strings, with row_no; quoted fields may hold line breaks, a byte-order mark is skipped."""
    want = HEADERS[source_id]
    got = [c.lstrip("﻿") for c in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns]
    if missing := [c for c in want if c not in got]:
        raise HeaderError(f"{path}: no column {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in got])
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).schema(schema).csv(path)
    return rows.withColumn("row_no", F.monotonically_increasing_id())


def _first(*names: str) -> Column:
    return F.coalesce(*[F.when(F.trim(n) != "", F.trim(n)) for n in names])


def ingest_census(rows: DataFrame, source_id: int, base_record: int = 0, base_person: int = 0) -> tuple[DataFrame, DataFrame]:
    """(record, recorded_person) of an extract's rows; ids follow the first row of each household, in file order."""
    late = source_id == 5
    cols = [c for c in rows.columns if c != "row_no"]
    line = F.to_csv(F.struct(*cols))
    who = F.trim(F.concat_ws(" ", F.when(F.trim("first_name" if late else "firstname") != "", F.trim("first_name" if late else "firstname")), F.when(F.trim("surname") != "", F.trim("surname"))))
    relation = _first("updated_relationship_to_head", "relationship_to_head") if late else _first("relation_to_head_updated", "relation_to_head")
    age, sex = ("updated_age", "updated_sex") if late else ("age", "sex")
    place = _first("townland") if late else _first("townland_clean", "townland")
    image = F.lit(None).cast("string") if late else F.nullif(F.regexp_extract("images", r"'id': *'([^']+)'", 1), F.lit(""))
    staged = rows.select(
        "row_no", "image_group", line.alias("line"), F.when(who != "", who).otherwise("[unknown]").alias("name_as_recorded"), X.map_role(relation).alias("role"),
        F.trim(age).alias("age_as_recorded"), X.parse_age(F.col(age)).alias("age"), F.trim(sex).alias("sex_as_recorded"),
        (F.lit(None).cast("string") if late else _first("occupation_updated", "occupation")).alias("occupation_as_recorded"), place.alias("place"),
        (F.trim("birthplace_county") if late else F.trim("birthplace")).alias("place_as_recorded"), relation.alias("relation"),
        F.coalesce(image, F.trim("aform_name") if late else F.lit(None).cast("string"), F.concat(F.lit("household-"), "image_group")).alias("document_id"), image.isNull().alias("no_image"),
    )
    staged = staged.withColumn("notes", X.notes([
        F.when(F.col("name_as_recorded") == "[unknown]", F.lit("name blank")),
        F.when(F.col("role") == "unknown", F.concat(F.lit("unmapped relation: "), "relation")),
        F.when((F.col("age_as_recorded") != "") & F.col("age").isNull(), F.concat(F.lit("age not a number: "), "age_as_recorded")),
    ]))
    homes = staged.groupBy("image_group").agg(
        F.min("row_no").alias("first_row"), F.min_by("document_id", "row_no").alias("document_id"), F.min_by("place", "row_no").alias("place_as_recorded"),
        F.min_by("no_image", "row_no").alias("no_image"), F.concat_ws("\n", F.lit(",".join(cols)), F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda s: s.line)).alias("raw_text"),
    )
    order = Window.orderBy("first_row")  # one row per household of a file
    record = homes.withColumn("record_id", F.row_number().over(order).cast("long") + base_record)
    note = F.when(F.col("no_image") & F.lit(not late), F.lit("no image id"))
    ids = record.select(F.col("image_group").alias("_group"), "record_id")
    record = record.select(
        "record_id", F.lit(source_id).alias("source_id"), F.to_json(F.struct("document_id", "image_group")).alias("record_parameters"), "raw_text", F.lit("census").alias("event_type"),
        F.lit(CENSUS_DATE[source_id]).alias("date_as_recorded"), F.lit(CENSUS_DATE[source_id]).alias("date"), F.lit("exact").alias("date_qualifier"), "place_as_recorded", note.alias("notes"),
    )
    person = staged.join(ids, F.col("image_group").eqNullSafe(F.col("_group")))
    person = person.withColumn("recorded_person_id", F.row_number().over(Window.orderBy("row_no")).cast("long") + base_person)
    return record, person.select("recorded_person_id", "record_id", "name_as_recorded", "role", "age_as_recorded", "age", "sex_as_recorded", "occupation_as_recorded", "place_as_recorded", "notes")


def source_of(path: str) -> int | None:
    """Source id from a year in a file's name."""
    m = re.search(r"_(1901|1911|1926)", path)
    return {"1901": 3, "1911": 4, "1926": 5}[m[1]] if m else None


def bulk_ingest(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, DataFrame | None, dict[str, str]]:
    """All extracts with a year in their name; a file that fails is reported and does not stop the others."""
    records = persons = None
    errors: dict[str, str] = {}
    for path in sorted(paths):
        if (source := source_of(path)) is None:
            errors[path] = "no census year in the name"
            continue
        try:
            r0, p0 = (0, 0) if records is None else (records.count(), persons.count())
            r, p = ingest_census(read_census(spark, path, source), source, r0, p0)
            records, persons = (r, p) if records is None else (records.unionByName(r), persons.unionByName(p))
        except HeaderError as e:
            errors[path] = str(e)
    return records, persons, errors


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """The place authority; a row without id, name or known type is an error."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    number = {"logainm_id", *(c for c in PLACE_HEADER if c.endswith("_id") and c != "place_id")}
    kinds = F.create_map(*[F.lit(x) for kv in PLACE_TYPE.items() for x in kv])
    cols = []
    for c in PLACE_HEADER:
        raw = F.trim(c) if c in rows.columns else F.lit(None).cast("string")
        raw = F.nullif(raw, F.lit(""))
        if c == "place_type":
            raw = F.try_element_at(kinds, F.lower(raw))
        kind = "long" if c == "place_id" or c in number else "double" if c in ("latitude", "longitude") else "string"
        cols.append(raw.try_cast(kind).alias(c))
    places = rows.select(*cols)
    bad = places.filter("place_id is null or name_en is null or place_type is null").limit(5).collect()
    if bad:
        raise ValueError(f"{path}: rows without place_id, name_en or place_type: {bad}")
    return places


def new_places(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming places that are not there yet: by logainm_id, or by name and type where they have none."""
    named = incoming.filter("logainm_id is not null").dropDuplicates(["logainm_id"]).join(existing.select("logainm_id"), "logainm_id", "left_anti").select(*incoming.columns)
    key = [F.lower("name_en").alias("_n"), F.col("place_type").alias("_t")]
    manual = incoming.filter("logainm_id is null").withColumn("_n", F.lower("name_en")).withColumn("_t", F.col("place_type")).dropDuplicates(["_n", "_t"])
    return named.unionByName(manual.join(existing.select(*key), ["_n", "_t"], "left_anti").select(*incoming.columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def clean_townland(x: Column) -> Column:
    return X.collapse(x)


def clean_ded(x: Column) -> Column:
    return X.collapse(x)
