"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, stored

ROUNDS = 40


def _stars(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star, over rows (u, v)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for every node of the links (u, v), bigint.

    Each round is written to the shared folder, so that a lost executor costs one round at most.
    """
    at = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(ROUNDS):
        new = stored(_stars(at))
        row = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop(at)
        at = new
        if tuple(row) == mark:
            roots = at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        mark = tuple(row)
    raise RuntimeError(f"the components need more than {ROUNDS} rounds")
