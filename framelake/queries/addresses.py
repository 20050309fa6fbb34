"""Addresses, names, headers and tags as columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..functions import pixel, text
from ..operators import filters, paths
from ..sources import datasource, formats, tags, uri
from .registrar import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN substr(props, 2, 5) WHEN 3 THEN substr(substr(props, 2, 6), 3, 2) ELSE substr(props, 1, 3) || event_type END AS data FROM events""")
def resolved_addresses(spark, sf_dir):
    """Payloads as data: addresses, base64 and percent-encoded, as slices, slices of slices, and concatenations."""
    e = tables.table(spark, sf_dir, "events")
    coded = F.concat(F.lit("data:application/json;base64,"), F.base64(F.col("props").cast("binary")))
    plain = F.concat(F.lit("data:,"), F.replace(F.url_encode("props"), F.lit("+"), F.lit("%20")))
    kinds = (coded, plain, F.concat(F.lit("slice:1+5!"), coded), F.concat(F.lit("slice:2+2!slice:1+6!"), plain), F.concat(F.lit("concat:slice:0+3!"), coded, F.lit("|data:,"), F.col("event_type")))
    address = F.get(F.array(*kinds), (F.col("event_id") % 5).cast("int"))
    return uri.resolved(e.select("event_id", address.alias("uri"))).select("event_id", F.col("data").cast("string").alias("data"))


@query("""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'wav' WHEN 1 THEN 'pnm' WHEN 2 THEN 'subrip' WHEN 3 THEN NULL WHEN 4 THEN 'obj' END AS format FROM pages""")
def container_choice(spark, sf_dir):
    """The format that an output's name asks for."""
    end = F.get(F.array(*map(F.lit, ("/a.WAV", "/b.x.ppm?q=1.wav", "/c.srt", "/d.mkv", "/e.obj", "/none"))), (F.col("page_id") % 6).cast("int"))
    return tables.table(spark, sf_dir, "pages").select("page_id", formats.format_of(F.concat("url", end)).alias("format"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'yuv420p' WHEN 1 THEN 'rgb24' WHEN 2 THEN NULL ELSE 'gray16le' END AS format FROM part")
def pixel_names(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, ("Yuv420P", "RGB24", "yuv999", "gray16LE"))), (F.col("p_partkey") % 4).cast("int"))
    return tables.table(spark, sf_dir, "part").select("p_partkey", pixel.pixel_format(name).alias("format"))


@query("SELECT conv_id, turn, replace(text, ' ', chr(10)) AS text FROM conversations")
def line_breaks(spark, sf_dir):
    """Texts with a byte order mark and three kinds of line breaks in one kind."""
    c = tables.table(spark, sf_dir, "conversations")
    mark = F.get(F.array(F.lit("\r\n"), F.lit("\r"), F.lit("\n")), F.pmod("turn", F.lit(3)).cast("int"))
    broken = F.concat(F.lit("﻿"), F.replace(F.col("text"), F.lit(" "), mark))
    return c.select("conv_id", "turn", text.normal_breaks(broken).alias("text"))


@query("""
SELECT channels, bits, user_id, CASE WHEN channels > 2 OR bits > 16 THEN 68 ELSE 44 END AS header, CASE WHEN channels > 2 OR bits > 16 THEN 'FEFF' ELSE '0100' END AS tag, sum(strlen(props))::BIGINT AS body
FROM events, (VALUES (1, 16), (2, 16), (6, 16), (2, 24)) v(channels, bits) GROUP BY 1, 2, 3""")
def wav_headers(spark, sf_dir):
    """Every user's payloads in four kinds of WAV files, and which header each takes."""
    packets = tables.packets(spark, sf_dir).select(F.col("asset_id").cast("string").alias("uri"), "pts", F.col("props").cast("binary").alias("data"))
    sizes = packets.groupBy("uri").agg(F.sum(F.octet_length("data")).cast("long").alias("body"))
    out = None
    for channels, bits in ((1, 16), (2, 16), (6, 16), (2, 24)):
        made = datasource.mux_wav(packets, channels, 48_000, bits).join(sizes, "uri")
        rows = made.select(F.lit(channels).alias("channels"), F.lit(bits).alias("bits"), F.col("uri").cast("long").alias("user_id"), (F.octet_length("data") - F.col("body")).cast("int").alias("header"), F.hex(F.substring("data", 21, 2)).alias("tag"), "body")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
WITH p AS (SELECT p_partkey, trim(substr(p_name, 1, 30)) AS title, p_brand AS artist, trim(substr(p_type, 1, 30)) AS album, p_partkey % 30 AS track FROM part)
SELECT p_partkey, 'title' AS k, title AS v FROM p UNION ALL SELECT p_partkey, 'artist', artist FROM p UNION ALL SELECT p_partkey, 'album', album FROM p UNION ALL SELECT p_partkey, 'track', track::VARCHAR FROM p WHERE track > 0""")
def audio_tags(spark, sf_dir):
    """Parts as the fixed tag at the end of a payload, read back."""
    field = lambda c, n: F.rpad(F.substring(c, 1, n), n, "\0").cast("binary")
    p = tables.table(spark, sf_dir, "part")
    track = F.unhex(F.lpad(F.hex((F.col("p_partkey") % 30).cast("long")), 2, "0"))
    tag = F.concat(F.lit(b"sound"), F.lit(b"TAG"), field("p_name", 30), field("p_brand", 30), field("p_type", 30), F.lit(bytes(33)), track, F.lit(b"\x0c"))
    found = tags.tags(p.select(F.col("p_partkey").cast("string").alias("uri"), tag.alias("data")))
    return found.select(F.col("uri").cast("long").alias("p_partkey"), "k", "v")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN repeat('80', 12) ELSE repeat('11', 12) END AS luma, CASE WHEN p_partkey % 3 = 0 THEN repeat('80', 2) ELSE repeat('22', 2) END AS chroma FROM part""")
def gray_planes(spark, sf_dir):
    """Planes of 4 x 3 pictures; every third conversion failed and is gray."""
    planes = F.when(F.col("p_partkey") % 3 != 0, F.array(F.unhex(F.repeat(F.lit("11"), F.lit(12))), F.unhex(F.repeat(F.lit("22"), F.lit(2))), F.unhex(F.repeat(F.lit("33"), F.lit(2)))))
    got = pixel.planes_or_gray(planes, F.lit(4), F.lit(3))
    return tables.table(spark, sf_dir, "part").select("p_partkey", F.hex(F.get(got, 0)).alias("luma"), F.hex(F.get(got, 1)).alias("chroma"))


@query("""
WITH e AS (SELECT event_type AS k, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY event_type) AS size FROM events),
w AS (SELECT p, j, j - p / 2.0 AS o FROM range(0, 2) a(p), range(-7, 9) b(j)),
v AS (SELECT p, j, CASE WHEN o = 0 THEN 1 ELSE sin(pi() * o * 2 / 3) / (pi() * o * 2 / 3) * cos(pi() * o / 18) * cos(pi() * o / 18) END AS v FROM w),
t AS (SELECT p, j, v / sum(v) OVER (PARTITION BY p) AS v FROM v),
m AS (SELECT k, unnest(range(0, (max(size) * 2 + 2) // 3)) AS n FROM e GROUP BY k)
SELECT m.k AS stream_key, m.n, round(sum(t.v * coalesce(e.x, 0)), 4) AS value FROM m JOIN t ON t.p = m.n * 3 % 2 LEFT JOIN e ON e.k = m.k AND e.n = m.n * 3 // 2 + t.j GROUP BY 1, 2""")
def resampled_streams(spark, sf_dir):
    """Every stream at two thirds of its rate, by sixteen windowed-sinc taps a phase."""
    from ..operators import blocked

    p = tables.packets(spark, sf_dir).select("stream_key", "ordinal", "value")
    p = blocked.running(p, "stream_key", "ordinal", blocked.ORDINALS, n=("count_before", F.lit(1))).select("stream_key", "n", "value")
    return filters.resample(p, "stream_key", "n", 3, 2, 8, 512).select("stream_key", "n", F.round("value", 4).alias("value"))


def _rounds(n: int) -> str:
    parts = [f"k{i + 1} AS (SELECT x.a, y.b, min(x.c + y.c) AS c FROM k{i} x JOIN k{i} y ON x.b = y.a GROUP BY 1, 2)" for i in range(n)]
    return ", ".join(parts)


@query(f"""
WITH e AS (SELECT p_brand AS a, lead(p_brand) OVER (ORDER BY p_partkey) AS b, p_size + 1 AS c FROM part), d AS (SELECT a, b, min(c) * 1000 + 1 AS c FROM e WHERE a <> b GROUP BY 1, 2),
k0 AS (SELECT * FROM d UNION ALL SELECT DISTINCT a, a, 0 FROM (SELECT a FROM d UNION ALL SELECT b FROM d)), {_rounds(5)}
SELECT a, b, (c // 1000)::BIGINT AS cost, (c % 1000)::BIGINT AS steps FROM k5""")
def conversion_matrix(spark, sf_dir):
    """Brands as formats, neighbours in the order of keys as direct conversions: the cheapest chain for every pair."""
    # a part's neighbour is found by its key, so there is no window over the table
    p = tables.table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") + 1).cast("long").alias("cost"))
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("b"))
    edges = p.join(after, "p_partkey").select(F.col("p_brand").alias("a"), "b", "cost")
    return paths.cheapest_paths(edges, 5).select("a", "b", "cost", (F.size("path") - 1).cast("long").alias("steps"))
