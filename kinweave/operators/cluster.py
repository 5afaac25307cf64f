"""Connected components, and purging clusters of rows from one source."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's setting that shuffle files go when the query that wrote them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The size up to which a join's side is sent to the tasks, and the most bytes of it while `few_sent` holds.
SENT, FEW = "spark.sql.autoBroadcastJoinThreshold", 1 << 18


@contextmanager
def few_sent(spark: SparkSession):
    """Queries run within send only small sides of joins unasked.

    Spark goes by the bytes of files, and by the share of the columns that are read: ten million of these can be millions of rows
    of a few ids, of which the driver makes a table for each join."""
    was = spark.conf.get(SENT)
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > FEW:
        spark.conf.set(SENT, str(FEW))
    try:
        yield
    finally:
        spark.conf.set(SENT, was)


def held(df: DataFrame) -> DataFrame:
    """Written to the shared folder that the session names, and read again: cuts lineage, outlives an executor."""
    spark = df.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        place = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        spark.sparkContext.setCheckpointDir(place)
    path = f"{place}/kinweave-{uuid.uuid4().hex}"
    # else what was shuffled for it stays on disk until the driver happens to collect its garbage
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.held_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what `held` wrote; the frame is not to be used after."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.held_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sent(df: DataFrame, most: int) -> DataFrame:
    """Held, and marked to be sent to the tasks if it has up to `most` rows."""
    df = held(df)
    return F.broadcast(df) if df.count() <= most else df


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the distinct nodes of edges, with the smallest node that they reach over these edges as root."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def star_edges(edges: DataFrame, most: int = 1 << 20, weight: str | None = None) -> DataFrame:
    """Edges (u, v) of long ids with the same components as `edges`: each task keeps an edge per node that it meets, not per edge.

    With `weight`, a double, also w: the largest weight of the edges that the task has met at u.

    A task reads `most` edges at a time; what is left of them is contracted with the next, or given out where it is half of `most`
    or more, so that no task holds more."""

    def run(batches):
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

        def batch(u, v, w):
            cols = [pa.array(u, pa.int64()), pa.array(v, pa.int64()), *([pa.array(w, pa.float64())] if weight else [])]
            return pa.RecordBatch.from_arrays(cols, names)

        def joined(kept, parts):
            u, v = (np.concatenate([kept[k], *[x[k] for x in parts]]) for k in (0, 1))
            nodes, roots = contract(u, v)
            best = np.full(len(nodes) if weight else 0, -np.inf)
            if weight:  # what was kept holds a node's weight, not an edge's
                np.maximum.at(best, np.searchsorted(nodes, kept[0]), kept[2])
                for x in parts:
                    for k in (0, 1):
                        np.maximum.at(best, np.searchsorted(nodes, x[k]), x[2])
            return nodes, roots, best

        kept, parts, n = none, [], 0
        for got in batches:
            t = pa.Table.from_batches([got])
            full = t.drop_null()
            if len(full) < len(t):  # an edge to null joins nothing
                nulls = t.filter(pa.compute.or_(t["u"].is_null(), t["v"].is_null()))
                yield from (nulls.rename_columns(names) if weight else nulls).to_batches()
            parts.append((full["u"].to_numpy(), full["v"].to_numpy(), full[weight].to_numpy() if weight else None))
            n += len(full)
            if n >= most:
                kept = joined(kept, parts)
                parts, n = [], 0
                if len(kept[0]) >= most // 2:
                    yield batch(*kept)
                    kept = none
        kept = joined(kept, parts)
        if len(kept[0]):
            yield batch(*kept)

    names = ["u", "v", *(["w"] if weight else [])]
    return edges.mapInArrow(run, ", ".join(f"{c} {'double' if c == 'w' else 'long'}" for c in names))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest node reachable as component; nodes are those of the edges.

    Long ids are first joined within the tasks that make the edges, so that edges grow with the nodes and are never shuffled or
    held as they come. Labels fall to the smallest neighbour and then to the label of their label, so the rounds grow with the
    logarithm of the longest chain; each round is two aggregates and joins on the edges, and only the last round's labels stay."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    if {t for _, t in both.dtypes} == {"bigint"}:
        both = held(star_edges(both))
    both = held(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = held(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")).select(F.col("u").alias("node"), "c"))
    kept = labels
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("c").alias("low"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("c").alias("was"), F.least("c", "low").alias("c"))
        jump = labels.select(F.col("node").alias("_n"), F.col("c").alias("_c"))
        step = held(step.join(jump, F.col("c") == F.col("_n"), "left").select("node", "was", F.least("c", F.coalesce("_c", "c")).alias("c")))
        forget(kept)
        kept, labels = step, step.select("node", "c")
        if step.filter("was <> c").isEmpty():
            return labels.select("node", F.col("c").alias("component"))


def purge_same_source(members: DataFrame, component: str = "component", source: str = "source_id") -> DataFrame:
    """Members whose source no other member of their component has."""
    n = F.count(F.lit(1)).over(Window.partitionBy(component, source))
    return members.withColumn("_n", n).filter("_n = 1").drop("_n")


def degrees(edges: DataFrame, start: DataFrame, n: int, a: str = "a", b: str = "b") -> DataFrame:
    """(node, degree) of the nodes within n steps of the start nodes."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    seen = start.select("node", F.lit(0).alias("degree")).distinct()
    for k in range(1, n + 1):
        front = seen.filter(F.col("degree") == k - 1).join(both, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct()
        seen = held(seen.unionByName(front.join(seen, "node", "left_anti").withColumn("degree", F.lit(k))))
    return seen
