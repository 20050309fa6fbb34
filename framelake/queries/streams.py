"""Packets, streams and seeking over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..operators import streams as op
from ..operators.blocked import MICROS, ORDINALS
from .registrar import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


@query("""
SELECT event_type AS stream_key, count(*)::BIGINT AS packets, min(epoch_us(ts)) AS first_pts, max(epoch_us(ts)) AS last_pts,
       sum(strlen(props))::BIGINT AS bytes, count(*) FILTER (WHERE event_id % 4 = 0)::BIGINT AS keyframes,
       max(epoch_us(ts)) - min(epoch_us(ts)) AS duration_us,
       ((sum(strlen(props))::HUGEINT * 8000000) // (max(epoch_us(ts)) - min(epoch_us(ts))))::BIGINT AS bitrate
FROM events GROUP BY 1""")
def probe_streams(spark, sf_dir):
    return op.probe(tables.packets(spark, sf_dir))


@query("SELECT event_type AS stream_key, event_id AS ordinal, epoch_us(ts) AS pts, strlen(props)::BIGINT AS size FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def stream_select(spark, sf_dir):
    return op.select_streams(tables.packets(spark, sf_dir), ["click", "view", "purchase"]).select("stream_key", "ordinal", "pts", "size")


@query("""
SELECT stream_key, n, ordinal FROM (
  SELECT event_type AS stream_key, event_id AS ordinal, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)::BIGINT AS n, event_id % 4 = 0 AS k FROM events)
WHERE k""")
def keyframe_ordinals(spark, sf_dir):
    return op.number(tables.packets(spark, sf_dir), "stream_key", "ordinal", width=ORDINALS).where("keyframe").select("stream_key", "n", "ordinal")


@query("""
WITH p AS (SELECT event_type AS stream_key, epoch_us(ts) AS pts, event_id % 4 = 0 AS k FROM events),
b AS (SELECT stream_key, min(pts) AS lo, max(pts) AS hi FROM p GROUP BY 1),
g AS (SELECT stream_key, lo + (hi - lo) * i // 10 AS target FROM b, range(0, 11) r(i))
SELECT g.stream_key, g.target, (SELECT max(pts) FROM p WHERE p.stream_key = g.stream_key AND p.k AND p.pts <= g.target) AS pts FROM g""")
def seek_keyframe_le(spark, sf_dir):
    packets = tables.packets(spark, sf_dir)
    ends = packets.groupBy("stream_key").agg(F.min("pts").alias("lo"), F.max("pts").alias("hi"))
    grid = ends.select("stream_key", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i"))
    targets = grid.select("stream_key", F.expr("lo + (hi - lo) * i div 10").alias("target"))
    return op.seek(packets, targets)


@query("""
SELECT p_partkey AS stream_index, media_type, sample_format,
  CASE WHEN wish IS NOT NULL OR media_type = 'Audio' THEN 'reencode' ELSE 'copy' END AS action,
  coalesce(wish, CASE WHEN media_type = 'Audio' THEN CASE sample_format WHEN 'U8' THEN 'pcm_u8' WHEN 'S24' THEN 'pcm_s24le' WHEN 'F32' THEN 'pcm_f32le' ELSE 'pcm_s16le' END END) AS output_codec
FROM (SELECT *, CASE WHEN media_type = 'Video' AND p_size > 40 THEN 'vp8' END AS wish FROM (
  SELECT p_partkey, p_size, CASE p_size % 4 WHEN 0 THEN 'Audio' WHEN 1 THEN 'Video' WHEN 2 THEN 'Subtitle' ELSE 'Data' END AS media_type,
  CASE (p_partkey % 5)::INT WHEN 0 THEN 'U8' WHEN 1 THEN 'S24' WHEN 2 THEN 'F32' WHEN 3 THEN 'odd' END AS sample_format FROM part))""")
def plan_streams(spark, sf_dir):
    media = F.element_at(F.array(*map(F.lit, ("Audio", "Video", "Subtitle", "Data"))), F.col("p_size") % 4 + 1)
    kind = F.get(F.array(*map(F.lit, ("U8", "S24", "F32", "odd"))), (F.col("p_partkey") % 5).cast("int"))
    part = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stream_index"), "p_size", media.alias("media_type"), kind.alias("sample_format"))
    typed = F.when((F.col("media_type") == "Video") & (F.col("p_size") > 40), "vp8")
    return op.plan(part, typed, F.lit(None).cast("string")).select("stream_index", "media_type", "sample_format", "action", "output_codec")


@query("""
SELECT o_custkey AS asset_id, coalesce(max(CASE WHEN o_custkey % 3 = 0 THEN 1000 * o_custkey END), max((round(o_totalprice)::BIGINT::HUGEINT * 1000000 // 90000)::BIGINT))::BIGINT AS duration_us
FROM orders GROUP BY 1""")
def container_duration(spark, sf_dir):
    streams = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset_id"), F.round("o_totalprice").cast("long").alias("duration"), F.lit(1).alias("tb_num"), F.lit(90000).alias("tb_den"))
    own = F.when(F.col("asset_id") % 3 == 0, 1000 * F.col("asset_id"))
    ticks = F.expr("duration * 1000000L div 90000L")
    return streams.groupBy("asset_id").agg(F.coalesce(F.max(own), F.max(ticks)).cast("long").alias("duration_us"))


@query("SELECT count(*)::BIGINT AS packets_read, count(*) FILTER (WHERE event_type <> 'purchase')::BIGINT AS packets_copied, count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS packets_encoded, count(*) FILTER (WHERE event_id % 4 = 0)::BIGINT AS frames_decoded FROM events")
def run_stats(spark, sf_dir):
    p = tables.packets(spark, sf_dir)
    encoded = F.col("stream_key") == "purchase"
    return p.agg(F.count(F.lit(1)).alias("packets_read"), F.count_if(~encoded).alias("packets_copied"), F.count_if(encoded).alias("packets_encoded"), F.count_if("keyframe").alias("frames_decoded"))


@query("""
WITH a AS (SELECT user_id, event_type, event_id, strlen(props) AS n, epoch_us(ts) AS pts, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS i FROM events)
SELECT x.i AS n, x.n::BIGINT AS size_a, y.n::BIGINT AS size_b, x.pts - y.pts AS pts_diff, (x.event_id % 4 = 0) = (y.event_id % 4 = 0) AS same_key
FROM (SELECT * FROM a WHERE event_type = 'click') x JOIN (SELECT * FROM a WHERE event_type = 'view') y USING (i)""")
def frame_compare(spark, sf_dir):
    p = op.number(tables.packets(spark, sf_dir), "stream_key", ["pts", "ordinal"], "i", MICROS).withColumn("n", F.col("i") + 1)
    x, y = p.where("stream_key = 'click'").alias("x"), p.where("stream_key = 'view'").alias("y")
    return x.join(y, "n").select("n", F.col("x.size").alias("size_a"), F.col("y.size").alias("size_b"), (F.col("x.pts") - F.col("y.pts")).alias("pts_diff"), (F.col("x.keyframe") == F.col("y.keyframe")).alias("same_key"))


@query("""
SELECT event_type AS stream_key, count(*) FILTER (WHERE strlen(props) <= 9)::BIGINT AS markers, (count(*) * 960)::BIGINT AS total_samples, sum(strlen(props))::BIGINT AS total_bytes FROM events GROUP BY 1""")
def silence_markers(spark, sf_dir):
    return tables.packets(spark, sf_dir).groupBy("stream_key").agg(F.count_if(F.col("size") <= 9).alias("markers"), (F.count(F.lit(1)) * 960).alias("total_samples"), F.sum("size").alias("total_bytes"))


@query("""
SELECT event_type AS stream_key, event_id AS ordinal, epoch_us(ts) AS pts, strlen(props)::BIGINT AS size,
  (row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_type, event_id))::BIGINT AS write_no, user_id AS asset_id FROM events""")
def interleave_on_write(spark, sf_dir):
    p = tables.packets(spark, sf_dir).withColumn("at", F.struct("pts", "stream_key", "ordinal"))
    return op.number(p, "asset_id", "at").select("stream_key", "ordinal", "pts", "size", (F.col("n") + 1).alias("write_no"), "asset_id")
