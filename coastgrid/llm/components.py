"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coastgrid.functions.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (``a, b``).

    Large-star and small-star steps in turn: each links the neighbours of a node to its
    smallest neighbour, first the larger ones, then the smaller ones.  The table never
    grows, and it ends when every child has one parent and no child is a parent, which is
    exact.  Every round is written to the shared folder.
    """
    pairs = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialise(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = materialise(large)
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialise(small.unionByName(parent.select("u", F.col("m").alias("v"))).distinct())
        children = pairs.groupBy("u").agg(F.count("*").alias("parents"))
        unsettled = pairs.select(F.col("v").alias("u")).join(children, "u", "left_semi")
        if children.filter("parents > 1").select("u").unionByName(unsettled).isEmpty():
            break
    children = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return children.unionByName(roots)
