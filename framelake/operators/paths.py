"""Cheapest chains between all pairs of a registry's formats, by min-plus joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cheapest_paths(edges: DataFrame, rounds: int) -> DataFrame:
    """(a, b, cost, path array): the cheapest chain of direct steps (a, b, cost long) from every a to every b that it reaches.

    A round joins what is known with itself, so ``rounds`` are enough for chains of
    2 ** rounds steps; every round keeps one chain a pair, of equal costs the one of
    fewer steps, then the first in order.  The relation is a registry's: its size is
    that of the formats, squared, whatever table its edges were counted from.
    """
    direct = edges.groupBy("a", "b").agg(F.min("cost").alias("cost")).where("a <> b").select("a", "b", "cost", F.array("a", "b").alias("path"))
    ends = direct.select(F.explode("path").alias("a")).distinct()
    known = ends.select("a", F.col("a").alias("b"), F.lit(0).cast(edges.schema["cost"].dataType).alias("cost"), F.array("a").alias("path")).unionByName(direct)
    for _ in range(rounds):
        on = known.select(F.col("a").alias("b"), F.col("b").alias("_b"), F.col("cost").alias("_cost"), F.col("path").alias("_path"))
        longer = known.join(on, "b").select("a", F.col("_b").alias("b"), (F.col("cost") + F.col("_cost")).alias("cost"), F.concat("path", F.slice("_path", 2, F.size("_path"))).alias("path"))
        best = F.min_by(F.struct("cost", "path"), F.struct("cost", F.size("path"), "path")).alias("best")
        known = longer.groupBy("a", "b").agg(best).select("a", "b", "best.cost", "best.path")
    return known
