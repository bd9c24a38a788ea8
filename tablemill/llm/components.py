"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Minima are aggregated before they meet the edges again, so a node with very many neighbours stays a splittable join key."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    met = both.join(lowest, "u")
    if large:  # neighbours above a node move to its smallest neighbour
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:  # edges point from the larger node u to the smaller v
        moved = met.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(lowest.select("u", F.col("low").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reachable. Input: columns u, v; loops and repeats are allowed.

    Each round writes its edges to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    current = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _is_stars(current):
        current = staged(_star(staged(_star(current, large=True)), large=False))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _is_stars(edges: DataFrame) -> bool:
    """Every node points to one smaller node only, and no node that is pointed to points further."""
    ups = edges.groupBy("u").agg(F.count("*").alias("n"))
    chained = edges.select("v").distinct().join(ups.select(F.col("u").alias("v")), "v", "left_semi")
    return ups.where("n > 1").isEmpty() and chained.isEmpty()
