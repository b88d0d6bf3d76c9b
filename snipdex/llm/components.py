"""Connected components of links by alternating stars: everything stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipdex.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, left: str, right: str, rounds: int = 40) -> DataFrame:
    """Rows (node, component) for every node with a link to another; the component is its smallest node.

    A hub with many links costs one row in each aggregate; the joins on it are split by adaptive execution. Every round
    is written to the shared folder. Loops (a node linked to itself) and nulls are ignored, repeated links count once.
    """
    u, v = F.greatest(left, right), F.least(left, right)
    edges = links.filter(F.col(left) != F.col(right)).select(u.alias("u"), v.alias("v")).distinct()
    edges = stored(edges, "links")
    mark = None
    for _ in range(rounds):
        edges = stored(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = now
    raise RuntimeError(f"components are not stable after {rounds} rounds")
