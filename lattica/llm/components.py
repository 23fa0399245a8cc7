"""Connected components of a link table, fully distributed (alternating large-star and small-star contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(u, v)`` to ``(id, component_id)``: each linked node with the smallest node it reaches.

    Self links and nulls are ignored, repeated links count once. Rounds grow with the logarithm of the longest chain. Each
    round aggregates minima and joins them back, so that a node with very many links is a skewed join that can be split,
    never a collected group.
    """
    links = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        links = checkpointed(_small_star(_large_star(links)))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(links.select("v", "v").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
