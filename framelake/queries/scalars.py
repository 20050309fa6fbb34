"""Scalar functions over addresses, sizes, clocks and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..functions import text, timebase
from .registrar import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

_SEGMENT = "split_part(list_extract(string_split(url, '/'), -1), '?', 1)"


@query(rf"SELECT page_id, nullif(lower(regexp_extract({_SEGMENT}, '\.([^.]*)$', 1)), '') AS ext FROM pages")
def url_ext(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", text.extension(F.col("url")).alias("ext"))


@query(rf"SELECT page_id, nullif(regexp_replace({_SEGMENT}, '\.[^.]*$', ''), '') AS stem FROM pages")
def url_stem(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", text.stem(F.col("url")).alias("stem"))


@query("""
SELECT doc_id, CASE WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%d KB', b // 1024) ELSE printf('%d B', b) END AS human,
  CASE WHEN b >= 1099511627776 THEN printf('%.1f TiB', b / 1099511627776.0) WHEN b >= 1073741824 THEN printf('%.1f GiB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.1f MiB', b / 1048576.0)
       WHEN b >= 1024 THEN printf('%.1f KiB', b / 1024.0) ELSE printf('%d B', b) END AS iec
FROM (SELECT doc_id, n_chars * n_chars AS b FROM documents)""")
def human_sizes(spark, sf_dir):
    b = F.col("n_chars") * F.col("n_chars")
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.human_bytes(b).alias("human"), text.iec_bytes(b).alias("iec"))


@query("""
SELECT event_type, lo, printf('%02d:%02d:%05.2f', us // 3600000000, (us // 60000000) % 60, (us % 60000000) / 1e6) AS hours,
  printf('%02d:%05.2f', us // 60000000, (us % 60000000) / 1e6) AS minutes,
  CASE WHEN us // 1000000 >= 3600 THEN printf('%d:%02d:%02d', us // 3600000000, (us // 60000000) % 60, (us // 1000000) % 60) ELSE printf('%d:%02d', us // 60000000, (us // 1000000) % 60) END AS overlay
FROM (SELECT event_type, user_id AS lo, max(epoch_us(ts)) - min(epoch_us(ts)) AS us FROM events GROUP BY 1, 2)""")
def clock_text(spark, sf_dir):
    d = tables.packets(spark, sf_dir).groupBy(F.col("stream_key").alias("event_type"), F.col("asset_id").alias("lo")).agg((F.max("pts") - F.min("pts")).alias("us"))
    return d.select("event_type", "lo", timebase.clock_hours(F.col("us")).alias("hours"), timebase.clock_minutes(F.col("us")).alias("minutes"), timebase.overlay_clock(F.col("us") / 1e6).alias("overlay"))


@query("""
SELECT event_id, ((us::HUGEINT * 90000 * 2 + 1000000) // 2000000)::BIGINT AS nearest, (us::HUGEINT * 90000 // 1000000)::BIGINT AS down,
  round(us * 1 / 1000000.0, 6) AS seconds FROM (SELECT event_id, epoch_us(ts) AS us FROM events)""")
def rescale_ticks(spark, sf_dir):
    us = F.col("pts")
    return tables.packets(spark, sf_dir).select(
        F.col("ordinal").alias("event_id"),
        timebase.rescale(us, 1, 1_000_000, 1, 90_000).alias("nearest"),
        timebase.rescale(us, 1, 1_000_000, 1, 90_000, "down").alias("down"),
        F.round(timebase.seconds_of(us, 1, 1_000_000), 6).alias("seconds"),
    )


@query("""
SELECT event_id, round(10.0 + greatest(0.0, value - event_id / 48000.0), 6) AS position, event_id // 48 AS seconds, (event_id % 48) * 1000000000 // 48 AS nanos,
  round(greatest(0.0, least(1.0, 0.5 + (value - 50) / 100)), 6) AS level FROM events""")
def clock_positions(spark, sf_dir):
    sample = timebase.sample_clock(F.col("event_id"), 48)
    position = timebase.clock_position(F.lit(10.0), F.col("value"), F.col("event_id").cast("double"), F.lit(48000.0))
    return tables.table(spark, sf_dir, "events").select("event_id", F.round(position, 6).alias("position"), sample["seconds"].alias("seconds"), sample["nanos"].alias("nanos"), F.round(timebase.volume(F.lit(0.5), F.col("value") - 50), 6).alias("level"))


@query("SELECT user_id, v, min(event_id) AS first_id FROM (SELECT user_id, event_id, (props->>'$.k')::VARCHAR AS v FROM events) GROUP BY 1, 2")
def metadata_dedupe(spark, sf_dir):
    """Identical (key, value) pairs once, at their first place."""
    e = tables.table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("v"))
    return e.groupBy("user_id", "v").agg(F.min("event_id").alias("first_id"))


@query("""
SELECT conv_id, turn, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN role END AS shown
FROM conversations""")
def repeat_key_suppress(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    changed = ~F.col("role").eqNullSafe(F.lag("role").over(w)) | (F.row_number().over(w) == 1)
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(changed, F.col("role")).alias("shown"))


@query("""
SELECT conv_id, coalesce(max(CASE WHEN turn = 0 THEN nullif(trim(text), '') END), max(CASE WHEN turn = 1 THEN nullif(trim(text), '') END), 'conversation ' || conv_id) AS title,
  max(CASE WHEN lower(role) = 'assistant' THEN turn END) AS last_answer FROM conversations GROUP BY 1""")
def track_titles(spark, sf_dir):
    clean = text.blank_to_null(F.col("text"))
    at = lambda n: F.max(F.when(F.col("turn") == n, clean))
    return tables.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.coalesce(at(0), at(1), F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))).alias("title"),
        F.max(F.when(F.lower("role") == "assistant", F.col("turn"))).alias("last_answer"),
    )


@query("""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
  replace(url, '/', '//') AS doubled, lower(md5(url)) AS digest FROM pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return tables.table(spark, sf_dir, "pages").select("page_id", F.parse_url(u, F.lit("PROTOCOL")).alias("scheme"), F.parse_url(u, F.lit("HOST")).alias("host"), F.parse_url(u, F.lit("PATH")).alias("path"), F.replace(u, F.lit("/"), F.lit("//")).alias("doubled"), F.md5(u).alias("digest"))
