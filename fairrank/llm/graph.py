"""Connected components of a large sparse graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairrank.llm.common import staged

MAX_ROUNDS = 100


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node joins the smallest node it sees."""
    n = _both_ways(e)
    low = n.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (n.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours join the smallest of them."""
    n = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = n.groupBy("u").agg(F.min("v").alias("m"))
    moved = n.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v; integers, u != v): root is the smallest node
    of its component.  Each round is two grouped joins over the current stars, written to the
    shared folder; a logarithmic number of rounds.  Nothing but one sum reaches the driver."""
    e = staged(edges.select("u", "v").where("u != v").distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        e = staged(_small_star(_large_star(e)), "stars")
        # stars are final when a round leaves the same set of edges
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select("u", F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
