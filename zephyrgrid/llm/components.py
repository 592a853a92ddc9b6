"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrgrid.session import stable


def _both_ways(links: DataFrame) -> DataFrame:
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.unionByName(back)


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    pairs = _both_ways(links)
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("_least"))
    return (pairs.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
            .filter("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; links point from large to small."""
    least = links.groupBy("a").agg(F.min("b").alias("_least"))
    moved = links.join(least, "a")
    return (moved.select(F.col("b").alias("a"), F.col("_least").alias("b"))
            .unionByName(least.select("a", F.col("_least").alias("b"))).filter("a <> b").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b), with the smallest node of its component as root.

    Each round writes its links; a node with very many links is counted before it is joined, and the join
    is one that adaptive execution can split. It ends when a round changes nothing.
    """
    ordered = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, mark = stable(ordered.distinct()), None
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
        now = stable(_small_star(_large_star(now)))
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
