"""Connected components of a table of links by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it instead."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return (
        both.join(least.hint("shuffle_merge"), "u")
        .where("v > u")
        .select(F.col("v").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("shuffle_merge"), "u").where("v <> m").select("v", "m")
    return moved.union(least).toDF("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all linked nodes but the smallest of each component, which names it.

    ``edges`` holds ids (a, b). Each round is written as a table, so a lost executor costs a round.
    """
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if sums[0] == 0 or tuple(sums) == before:
            return edges.toDF("node", "component")
        before = tuple(sums)
        edges = stored(_small_star(_large_star(edges)))
