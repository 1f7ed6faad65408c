"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.runtime import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node with a link to another.

    A round hangs the neighbours of each node below the smallest one; the number of rounds grows with
    the logarithm of the longest path. Each round is written to the shared folder, so a lost executor
    replays one round at most. NULL ends and self-links are ignored; repeated links count once.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    links = cut(edges.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct())
    mark = _mark(links)
    while mark[0]:
        links = cut(_small_star(_large_star(links)))
        now = _mark(links)
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    """Number of links and an order-free sum of their hashes: equal when a round changed nothing."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
