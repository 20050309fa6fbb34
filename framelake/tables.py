"""Canonical schemas, and the driver's tables bound to media roles as stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKETS = "asset_id long, stream_key string, ordinal long, tb_num long, tb_den long, pts long, dts long, duration long, keyframe boolean, data binary"
STREAMS = "asset_id long, stream_index int, media_type string, codec_id string, tb_num long, tb_den long, duration long, channels int, sample_rate int, sample_format string, channel_layout string, width int, height int, pixel_format string"
AUDIO_FRAMES = "asset_id long, stream_index int, frame_no long, pts long, samples int, planes array<array<float>>"
VIDEO_FRAMES = "asset_id long, stream_index int, frame_no long, pts long, planes array<struct<stride:int,data:binary>>"
CUES = "cue_no long, start_us long, end_us long, text string"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """The SQL front end: every table as a view."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def micros(column: str) -> F.Column:
    """A timestamp without zone as microseconds since 1970."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as packets: type = stream, microseconds = pts in 1/1000000, every fourth id a keyframe."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("asset_id"),
        F.col("event_type").alias("stream_key"),
        F.col("event_id").alias("ordinal"),
        micros("ts").alias("pts"),
        F.octet_length("props").cast("long").alias("size"),
        (F.col("event_id") % 4 == 0).alias("keyframe"),
        "value",
        "props",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as mono audio frames of 64 samples."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_no"), F.col("embedding").cast("array<double>").alias("samples"), F.col("label").alias("stream_index"))


def codec_impls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as registry rows: type = codec, brand = backend, size = priority, key = order of registration."""
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("codec"), F.col("p_brand").alias("backend"), F.col("p_size").alias("priority"), F.col("p_partkey").alias("seq"), "p_name", "p_retailprice")
