"""Reference graphs as edge tables (src, dst, pos): existing edges, inverse, closure, bounded breadth-first expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from docgraph.runtime import checkpoint_folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that the plans of later rounds stay small."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def existing(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges whose target is a node; dangling ones go."""
    return edges.join(nodes.select(F.col(key).alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns)


def dangling(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    return edges.join(nodes.select(F.col(key).alias("dst")).distinct(), "dst", "left_anti").select(*edges.columns)


def inverse(edges: DataFrame) -> DataFrame:
    """(id, referenced_by): sources of each target, in order of the sources."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("referenced_by"))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): everything reachable from each source, itself included only if a cycle leads back to it.

    Each round doubles the distance covered: pairs exactly as far apart as is known so far are joined with all that are
    known, and pairs known already go, so a path of n edges takes about log2(n) rounds. It ends when none is new.
    """
    step = edges.select("src", "dst").where("src <> dst").distinct()
    known, covered = cut(step.withColumn("far", F.lit(1).cast("long"))), 1
    while True:
        head = known.where(F.col("far") == covered).select("src", F.col("dst").alias("via"))
        tail = known.select(F.col("src").alias("via"), "dst", "far")
        grown = head.join(tail, "via").groupBy("src", "dst").agg((F.min("far") + covered).alias("far"))
        fresh = cut(grown.join(known, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return known.select("src", "dst")
        known, covered = cut(known.union(fresh)), 2 * covered


def dependencies(edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(src, dst, deps): every direct reference with the sorted set of what it reaches, itself excluded."""
    reach = closure(edges) if reach is None else reach
    deps = reach.where("src <> dst").groupBy(F.col("src").alias("dst")).agg(F.array_sort(F.collect_set("dst")).alias("deps"))
    return edges.select("src", "dst", "pos").join(deps, "dst", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))


def expand(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, max_total: int | None = 15) -> DataFrame:
    """(query, node, depth, ord): breadth-first expansion of many queries at once, in the order of a queue.

    ``seeds`` is (query, node, ord). Of a level, nodes stand in the order of their first parent and the reference's place
    in it; a node counts at its first sight only; seeds themselves are not returned. ``max_total`` cuts each query's
    order. ``edges`` must have no dangling targets. At most ``max_depth`` rounds, each one equi join, one minimum per
    node and one anti join.
    """
    visited = cut(seeds.select("query", "node", F.lit(0).alias("depth"), F.col("ord").cast("long").alias("ord")))
    frontier = visited
    for depth in range(1, max_depth + 1):
        seen = frontier.join(edges.withColumnRenamed("src", "node"), "node").select("query", F.col("dst").alias("node"), F.struct("ord", "pos").alias("at"))
        seen = seen.groupBy("query", "node").agg(F.min("at").alias("at")).join(visited.select("query", "node"), ["query", "node"], "left_anti")
        place = F.row_number().over(W.Window.partitionBy("query").orderBy("at", "node"))
        frontier = cut(seen.select("query", "node", F.lit(depth).alias("depth"), place.cast("long").alias("ord")))
        visited = visited.union(frontier)
        if frontier.isEmpty():
            break
    found = visited.where("depth > 0")
    if max_total is not None:
        rank = F.row_number().over(W.Window.partitionBy("query").orderBy("depth", "ord"))
        found = found.withColumn("place", rank).where(F.col("place") <= max_total).drop("place")
    return found


def depth_histogram(expanded: DataFrame) -> DataFrame:
    return expanded.groupBy("query", "depth").agg(F.count("*").alias("n"))
