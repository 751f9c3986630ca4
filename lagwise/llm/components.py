"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import discard, store


def _smaller_to_all(edges: DataFrame) -> DataFrame:
    """Large star: every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    """Small star: a node and its smaller neighbours are tied to the smallest of them.  Edges are (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (columns a, b); the root is the least node of its component.

    Each round is a handful of partial aggregations and joins over the edges, ends in a written table and at
    least shortens every path to the root; only a count and a checksum come to the driver.  Self-loops and
    repeated edges are allowed.
    """
    current = store(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(current)
    while before[0]:
        following = store(_smaller_to_least(_smaller_to_all(current).distinct()).distinct(), "edges")
        after = _state(following)
        discard(current)
        current = following
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
