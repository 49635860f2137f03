"""Connected components by alternating stars, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its least node.

    Alternates large stars (each node's greater neighbours go to its least neighbour) and small stars (its lesser ones
    do), whose rounds grow with the logarithm of a component's size, until the edges are stars. Every round is written
    to the shared checkpoint folder. Each step is a minimum by key, combined before its shuffle, and an equi join.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), small=True)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), small=True)
        rows, nodes = e.agg(F.count("*"), F.countDistinct("u")).head()
        if rows == nodes and e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            break
    tops = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops.select("node", F.col("node").alias("component")))
