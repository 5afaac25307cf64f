"""Paged REST sources: pages are fetched on the driver by a function that is passed in, and become DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import clean_ded, clean_townland

PAGE = 1000


def get(row: dict, *names: str):
    """First value under any of the names, whatever their case."""
    lower = {k.lower(): v for k, v in row.items()}
    return next((lower[n.lower()] for n in names if lower.get(n.lower()) is not None), None)


def pages(fetch: Callable[[int, int], list[dict]], size: int = PAGE, tries: int = 3, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[list[dict]]:
    """Pages by limit and offset until a short one; a failed page is tried again after 1, 2, 4 ... seconds."""
    offset = 0
    while True:
        for k in range(tries):
            try:
                rows = fetch(size, offset)
                break
            except OSError:
                if k + 1 == tries:
                    raise
                sleep(2.0**k)
        if rows:
            yield rows
        if len(rows) < size:
            return
        offset += size
        sleep(pause)


def census(spark: SparkSession, fetch: Callable[[int, int], list[dict]], year: int, columns: list[str], **how) -> DataFrame:
    """Rows of one census year as strings, with cleaned townland and district."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    out = spark.createDataFrame([], schema)
    for rows in pages(fetch, **how):
        out = out.unionByName(spark.createDataFrame([tuple(None if (v := get(r, c)) is None else str(v) for c in columns) for r in rows], schema))
    out = out.filter(F.col("census_year") == str(year))
    return out.withColumn("townland_clean", clean_townland(F.col("townland"))).withColumn("ded_clean", clean_ded(F.col("ded")))


def places(spark: SparkSession, parent: dict, fetch: Callable[[int, int], list[dict]], **how) -> DataFrame:
    """A parent place and its children: logainm_id, name_en, place_type, parent_id, latitude, longitude."""
    from .ingest import PLACE_TYPE

    def row(p: dict, parent_id: int | None) -> tuple:
        kind = str(get(p, "type", "place_type", "category") or "").lower()
        place = lambda k: None if (v := get(p, k)) is None else float(v)
        return (int(get(p, "id", "logainm_id")), get(p, "name_en", "nameEN", "name"), PLACE_TYPE.get(kind, kind), parent_id, place("latitude"), place("longitude"))

    top = row(parent, None)
    rows = [top, *(row(p, top[0]) for page in pages(fetch, **how) for p in page)]
    return spark.createDataFrame(rows, "logainm_id long, name_en string, place_type string, parent_id long, latitude double, longitude double").dropDuplicates(["logainm_id"])
