"""Connected components by alternating star contraction (distributed, no collect)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import drop, store


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of node and neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (both.filter("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)),
                           F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of its component.

    ``links`` has two long columns; self-links, repeated and reversed links are
    harmless, no links give no rows. Each round writes its links to the shared
    folder, so lineage stays short; rounds end when the links no longer change,
    which takes about the logarithm of the longest path.
    """
    spark = links.sparkSession
    start = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges, path = store(start.filter("a <> b").distinct(), "links")
    before = _signature(edges)
    while before[0]:
        after_edges, after_path = store(_small_star(_large_star(edges)), "links")
        drop(spark, path)
        edges, path = after_edges, after_path
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
