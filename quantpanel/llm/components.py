"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantpanel.llm.common import cut


def lowest_neighbours(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours that are larger (or: it and its smaller ones) move to the smallest node next to it.

    The smallest node is an aggregate with map-side combine and is joined back, so a node with very many neighbours is
    spread over tasks.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least.select("u", F.least("u", "m").alias("m")), "u")
    moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the smallest node of its component. Edges: u, v (long)."""
    edges = cut(edges.where(F.col("u") != F.col("v")).select("u", "v"))
    mark = None
    while True:
        edges = cut(lowest_neighbours(lowest_neighbours(edges, True), False))
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
