"""Connected components of an edge table, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _with_least(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Edges (u, v) with the least node m of u's neighbourhood, u included."""
    if both_ways:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (u, v); the label is the least node of the component.

    Minima are combined before the shuffle and stars are joined back by node, so a hub's neighbours never meet in one
    task. Nulls must not occur; loops and repeated edges do no harm; no edges give no rows. The rounds end when the stars
    have settled, after a number that grows with the logarithm of the longest path.
    """
    stars = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        big = _with_least(stars, both_ways=True).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _with_least(big, both_ways=False)  # every u > v here
        new = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = checkpointed(new)
        # settled when no node is the centre of one star and a leaf of another, and every leaf has one centre
        leaves = new.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        open_ = leaves.filter("m <> most").select("u").unionByName(leaves.select("u").join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi"))
        stars = new
        if open_.isEmpty():
            leaf = stars.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return leaf.unionByName(leaf.select(F.col("label").alias("node"), "label").distinct())
