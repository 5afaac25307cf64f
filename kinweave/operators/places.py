"""Place strings to the place authority."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..constants import PLACE_EXACT, PLACE_FUZZY, PLACE_THRESHOLD
from ..functions import text as X

#: Rows of an authority that are sent to the tasks at once.
MOST_PLACES = 50_000


def _best_of(known):
    """Column function: the best of broadcast (name, place_id) for each token."""

    def best(given: pd.Series) -> pd.DataFrame:
        exact = {name: i for name, i in reversed(known.value)}
        out = []
        for t in given:
            top, at = (1.0, exact[t]) if t in exact else (-1.0, None)
            if at is None:
                for name, i in known.value:
                    if (score := X.jaro_winkler_of(t, name)) > top:
                        top, at = score, i
            out.append((top, at))
        return pd.DataFrame(out, columns=["similarity", "place_id"])

    return pandas_udf(best, "similarity double, place_id long")


def best_matches(tokens: DataFrame, authority: DataFrame, token: str = "token") -> DataFrame:
    """token, place_id, similarity of the best authority name for each distinct token; ties: smallest id.

    The authority goes to the tasks in slices of about MOST_PLACES names, and a token keeps its best of all
    slices, so no pair leaves a task."""
    spark = tokens.sparkSession
    names = authority.select("place_id", X.normalise_place(F.col("name_en")).alias("name")).filter("name <> ''").groupBy("name").agg(F.min("place_id").alias("place_id"))
    slices = max(1, -(-names.count() // MOST_PLACES))
    wanted, found = tokens.select(token).distinct(), None
    for k in range(slices):
        part = names.filter(F.pmod(F.xxhash64("name"), F.lit(slices)) == k).orderBy("place_id").collect()
        best = _best_of(spark.sparkContext.broadcast([(r["name"], r["place_id"]) for r in part]))
        scored = wanted.withColumn("b", best(token)).select(token, "b.place_id", "b.similarity").filter("place_id is not null")
        found = scored if found is None else found.unionByName(scored)
    top = found.groupBy(token).agg(F.max(F.struct("similarity", (-F.col("place_id")).alias("k"))).alias("b"))
    return top.select(token, (-F.col("b.k")).alias("place_id"), F.col("b.similarity").alias("similarity"))


def resolve(records: DataFrame, authority: DataFrame, linked: DataFrame | None = None, threshold: float = PLACE_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(place_record rows, unresolved tokens with their best hint) for records that have no place yet."""
    todo = records.join(linked.select("record_id"), "record_id", "left_anti") if linked is not None else records
    tokens = todo.filter("trim(place_as_recorded) <> ''").select("record_id", X.normalise_place(F.col("place_as_recorded")).alias("token")).filter("token <> ''")
    best = best_matches(tokens, authority)
    score = F.when(F.col("similarity") == 1, PLACE_EXACT).otherwise(PLACE_FUZZY)
    done = tokens.join(best.filter(F.col("similarity") >= threshold), "token").select("place_id", "record_id", score.alias("score"), F.lit(0).alias("verified"))
    left = tokens.groupBy("token").count().join(best.filter(F.col("similarity") < threshold), "token")
    return done, left.select("token", F.col("count").alias("records"), F.col("place_id").alias("best_place_id"), F.col("similarity").alias("best_similarity"))
