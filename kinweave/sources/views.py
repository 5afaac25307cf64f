"""Evidence-shaped tables over the order tables, in SQL that Spark and DuckDB read alike.

record: a household return per order; recorded_person: a row per line item, named by its keys; link: recorded
persons of neighbouring orders under one person. They let every operator run over whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _pick(key: str, words: str) -> str:
    names = words.split()
    return f"split_part('{','.join(names)}', ',', CAST(({key}) % {len(names)} + 1 AS int))"


FORENAMES = "Patrick Mary John Margaret James Bridget Pat Annie Michael Catherine Hugh Kate Thomas Sarah William Ellen Paddy Rose Owen Maggie Jimmy Bid Frank Lizzie Robert Grace Bob Molly Daniel Nora Francis"
SURNAMES = "OBrien Kelly McNamara MacNamara Gallagher Gallaher Boyle Doherty Dogherty Sweeney Walsh Byrne Ward Mack Owens Cassidy Timoney Meehan Travers Furey Harvey Connell Quinn Pfister Diver McGinty McGinley Brien Mulhern"
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus"

VIEWS = {
    "record": """
        SELECT o_orderkey AS record_id, CAST(3 + o_orderkey % 3 AS int) AS source_id, CAST(n_nationkey + 1 AS bigint) AS place_id,
          n_name AS place_as_recorded, CASE o_orderkey % 3 WHEN 0 THEN '1901-03-31' WHEN 1 THEN '1911-04-02' ELSE '1926-04-18' END AS date
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "recorded_person": f"""
        SELECT l_orderkey * 100 + rn AS recorded_person_id, l_orderkey AS record_id,
          {_pick("l_partkey + 7 * rn", FORENAMES)} || ' ' || {_pick("l_orderkey + l_orderkey % 7", SURNAMES)} AS name_as_recorded,
          CASE rn WHEN 1 THEN 'head' WHEN 2 THEN 'spouse' WHEN 3 THEN 'son' WHEN 4 THEN 'daughter' WHEN 5 THEN 'sibling' WHEN 6 THEN 'servant' END AS role,
          CAST(l_quantity AS int) AS age, CASE l_returnflag WHEN 'A' THEN 'M' WHEN 'R' THEN 'F' END AS sex_as_recorded, l_linestatus AS occupation
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS rn FROM {{lineitem}}) AS t""",
    "person_row": """
        SELECT p.*, r.source_id, r.place_id, r.place_as_recorded, r.date, CAST(substring(r.date, 1, 4) AS int) - p.age AS birth_year
        FROM {recorded_person} p JOIN {record} r ON p.record_id = r.record_id""",
    "link": """
        SELECT (record_id - record_id % 4) * 100 + recorded_person_id % 100 AS person_id, recorded_person_id,
          CAST(45 + record_id % 55 AS double) / 100 AS score
        FROM {recorded_person} WHERE recorded_person_id % 100 <= 6""",
    "person": """
        SELECT l.person_id, min(p.name_as_recorded) AS label, CASE WHEN min(p.sex_as_recorded) = max(p.sex_as_recorded) THEN min(p.sex_as_recorded) END AS gender,
          CASE WHEN l.person_id % 700 = 1 THEN 'merged' ELSE 'active' END AS status
        FROM {link} l JOIN {recorded_person} p ON l.recorded_person_id = p.recorded_person_id GROUP BY l.person_id""",
    "event": """
        SELECT person_id * 10 + 1 AS event_id, person_id, 'birth' AS type, CAST(birth_year AS string) || '-01-01' AS date, 1 AS is_primary
          FROM (SELECT l.person_id, min(p.birth_year) AS birth_year FROM {link} l JOIN {person_row} p ON l.recorded_person_id = p.recorded_person_id WHERE l.person_id % 3 <> 0 GROUP BY l.person_id) AS b
        UNION ALL SELECT person_id * 10 + 2, person_id, 'birth', '1880', 1 FROM {person} WHERE person_id % 11 = 4
        UNION ALL SELECT person_id * 10 + 3, person_id, 'death', CAST(1900 + person_id % 27 AS string), 1 FROM {person} WHERE person_id % 5 = 2
        UNION ALL SELECT person_id * 10 + 4, person_id, 'death', '1920-02', 1 FROM {person} WHERE person_id % 45 = 2
        UNION ALL SELECT person_id * 10 + 5, person_id, 'baptism', CAST(1860 + person_id % 40 AS string), 1 FROM {person} WHERE person_id % 7 = 3
        UNION ALL SELECT person_id * 10 + 6, person_id, 'marriage', CAST(1880 + person_id % 40 AS string), 1 FROM {person} WHERE person_id % 4 = 1
        UNION ALL SELECT person_id * 10 + 7, person_id, 'burial', CAST(1895 + person_id % 30 AS string), 1 FROM {person} WHERE person_id % 5 = 2
        UNION ALL SELECT person_id * 10 + 8, person_id, 'census', '1911-04-02', 0 FROM {person}""",
    "relationship": """
        SELECT a.person_id * 10 + 1 AS relationship_id, a.person_id AS person_id_1, b.person_id AS person_id_2, 'parent_child' AS type
          FROM {person} a JOIN {person} b ON b.person_id = a.person_id + 2 WHERE a.person_id % 100 IN (1, 2)
        UNION ALL SELECT a.person_id * 10 + 2, a.person_id, b.person_id, 'parent_child' FROM {person} a JOIN {person} b ON b.person_id = a.person_id + 3 WHERE a.person_id % 100 = 1
        UNION ALL SELECT a.person_id * 10 + 3, a.person_id, b.person_id, 'couple' FROM {person} a JOIN {person} b ON b.person_id = a.person_id + 1 WHERE a.person_id % 100 = 1
        UNION ALL SELECT a.person_id * 10 + 4, a.person_id, b.person_id, 'couple' FROM {person} a JOIN {person} b ON b.person_id = a.person_id + 4 WHERE a.person_id % 1600 = 1""",
    "similarity": """
        SELECT a.recorded_person_id AS id_1, b.recorded_person_id AS id_2, CAST(30 + (a.recorded_person_id + b.recorded_person_id) % 70 AS double) / 100 AS score
        FROM {person_row} a JOIN {person_row} b ON a.name_as_recorded = b.name_as_recorded AND a.place_id = b.place_id AND a.birth_year = b.birth_year
        WHERE a.source_id < b.source_id""",
    "log": """
        SELECT event_id AS log_id, user_id AS entity_id, event_type AS field_name, CAST(event_id % 97 AS string) AS change_group_id,
          CASE event_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'verify' ELSE 'delete' END AS action, ts AS created_at, value
        FROM {events}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A driver table or one of VIEWS, as a lazy DataFrame; views in `made` are taken from there."""
    if made and name in made:
        return made[name]
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n, made) for n in set(re.findall(r"\{(\w+)\}", text))})


def ctes(text: str) -> str:
    """DuckDB SQL with the views that `text` names in braces defined before it."""
    done: list[str] = []

    def need(body: str) -> None:
        for n in re.findall(r"\{(\w+)\}", body):
            if n in VIEWS and n not in done:
                need(VIEWS[n])
                done.append(n)

    need(text)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    heads = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in done)
    body = plain(text).strip()
    if not done:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {body[14:]}"
    return f"WITH {heads}, {body[4:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"
