"""Connected components by alternating large and small stars, checkpointed each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_with_hot_keys

#: Ids of fewer links meet their minimum by shuffle.
HUB_LINKS = 20_000


def components(links: DataFrame, parts: int = 8) -> DataFrame:
    """(id, component) of every id in links (a, b), component the smallest id reachable.

    Every round is a grouped minimum and a join; no component is gathered anywhere,
    and an id with very many links meets its minimum by broadcast.
    Loops and repeated links are allowed; ids without a link are not returned.
    parts: tasks that the links are dealt to between shuffles, by their number.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).coalesce(parts).distinct().coalesce(parts))
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        state, total = now, 2 * now[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_with_hot_keys(both.where("v > u"), least, ["u"], "n", total, HUB_LINKS).select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)
        large = cut(large) if total > HUB_LINKS else large  # it is read four times then
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_with_hot_keys(large, least, ["u"], "n", total, HUB_LINKS).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts))
