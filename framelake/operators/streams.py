"""Stream probing, selection, seeking and planning over packet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.audio import pcm_codec
from .blocked import running


def probe(packets: DataFrame, by: str = "stream_key") -> DataFrame:
    """One row a stream: packets, first and last pts, duration, bytes, integer bitrate (null without a duration)."""
    out = packets.groupBy(by).agg(
        F.count(F.lit(1)).alias("packets"),
        F.min("pts").alias("first_pts"),
        F.max("pts").alias("last_pts"),
        F.sum("size").alias("bytes"),
        F.count_if("keyframe").alias("keyframes"),
    )
    duration = F.col("last_pts") - F.col("first_pts")
    bits = (F.col("bytes") * 8).cast("decimal(38,0)") * 1_000_000
    rate = F.when((duration > 0) & (F.col("bytes") > 0), F.floor(bits / F.when(duration > 0, duration)))
    return out.withColumn("duration_us", duration).withColumn("bitrate", rate.cast("long"))


def select_streams(packets: DataFrame, keys: list[str] | None, by: str = "stream_key") -> DataFrame:
    """Packets of the wanted streams (None: all), with their ordinal."""
    return packets if keys is None else packets.where(F.col(by).isin(*keys))


def number(rows: DataFrame, by: str, order: str | list[str], name: str = "n", width: float | None = None) -> DataFrame:
    """Rows numbered from 0 within ``by``; with a width, stream by stream in blocks of it."""
    order = [order] if isinstance(order, str) else order
    if width is not None:
        return running(rows, by, order, width, **{name: ("count_before", F.lit(1))})
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))


def seek(packets: DataFrame, targets: DataFrame, by: str = "stream_key") -> DataFrame:
    """(by, target, pts): the last keyframe at or before each target of a stream, null if none.

    An as-of join by union and window: linear in both inputs, no range join.
    """
    keys = packets.where("keyframe").select(by, F.col("pts").alias("t"), F.col("pts").alias("key_pts"), F.lit(0).alias("side"))
    asked = targets.select(by, F.col("target").alias("t"), F.lit(None).cast("long").alias("key_pts"), F.lit(1).alias("side"))
    last = Window.partitionBy(by).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = keys.unionByName(asked).withColumn("found", F.last("key_pts", ignorenulls=True).over(last))
    return found.where("side = 1").select(by, F.col("t").alias("target"), F.col("found").alias("pts"))


def plan(streams: DataFrame, typed: Column, overall: Column) -> DataFrame:
    """Adds action and output_codec: a typed wish, else the overall one, re-encodes; audio becomes PCM; the rest is copied."""
    wish = F.coalesce(F.when(F.col("media_type").isin("Audio", "Video", "Subtitle"), typed), overall)
    audio = F.col("media_type") == "Audio"
    return streams.withColumns(
        {
            "action": F.when(wish.isNotNull() | audio, "reencode").otherwise("copy"),
            "output_codec": F.coalesce(wish, F.when(audio, pcm_codec(F.col("sample_format")))),
        }
    )


def container_duration(streams: DataFrame, own: Column) -> DataFrame:
    """duration_us per asset: the container's, else the longest stream's."""
    ticks = (F.col("duration").cast("decimal(38,0)") * F.col("tb_num") * 1_000_000 / F.col("tb_den")).cast("long")
    return streams.groupBy("asset_id").agg(F.coalesce(F.max(own), F.max(ticks)).alias("duration_us"))


def with_stream_params(packets: DataFrame, streams: DataFrame, by: str = "stream_key") -> DataFrame:
    """packets with their stream's columns and seconds, pts in its time base (tb_num over tb_den); packets of unknown streams keep nulls."""
    met = packets.join(streams, by, "left")
    return met.withColumn("seconds", F.col("pts") * F.col("tb_num") / F.col("tb_den"))


def first_of(packets: DataFrame, by: str, kind: str, order: str) -> DataFrame:
    """(by, kind, order): the first packet of every kind in every ``by``, by partial minima."""
    return packets.groupBy(by, kind).agg(F.min(order).alias(order))


def drain_ticks(messages: DataFrame, by: str, order: str, most: int = 32) -> DataFrame:
    """Adds tick (from 0): a consumer takes at most so many messages of a queue at a time."""
    return number(messages, by, order, "_n").withColumn("tick", F.floor(F.col("_n") / most)).drop("_n")


def ends(packets: DataFrame, by: str, clock: str, picture: str) -> DataFrame:
    """(by, clock_end, picture_end, end_us, trailing): when each media type runs out, and which one plays on alone."""
    last = lambda key: F.max(F.when(F.col("stream_key") == key, F.col("pts")))
    rows = packets.groupBy(by).agg(last(clock).alias("clock_end"), last(picture).alias("picture_end"), F.max("pts").alias("end_us"))
    trailing = F.when(F.col("clock_end") > F.col("picture_end"), clock).when(F.col("clock_end") < F.col("picture_end"), picture)
    return rows.withColumn("trailing", trailing)
