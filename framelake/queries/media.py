"""Containers, subtitles, pictures, geometry and player rules, each against SQL over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import tables
from ..functions import audio, digest, mesh, pixel, text, timebase
from ..operators import blocked, extras, filters, metrics, registry, skeleton, streams, timeline
from ..sources import codecs, datasource, generate, meshes, subtitles, transport
from .registrar import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

# Packets and streams


@query("SELECT event_id, md5(props) AS md5, event_id % 10 <> 0 AS intact FROM events")
def payload_checks(spark, sf_dir):
    """Declared checksums against payloads, every tenth of which was changed after its checksum was taken."""
    e = tables.table(spark, sf_dir, "events").withColumns({"md5": F.md5(F.col("props").cast("binary")), "crc": F.crc32(F.col("props").cast("binary"))})
    got = F.when(F.col("event_id") % 10 == 0, F.concat("props", F.lit("x"))).otherwise(F.col("props"))
    return e.select("event_id", "md5", digest.verified(got, F.col("crc"), F.upper("md5")).alias("intact"))


@query("""
WITH s AS (SELECT event_type, row_number() OVER (ORDER BY event_type)::INT - 1 AS stream_index FROM (SELECT DISTINCT event_type FROM events))
SELECT event_id, stream_index, epoch_us(ts)::DOUBLE / (1000 * (stream_index + 1))::DOUBLE AS seconds FROM events JOIN s USING (event_type)""")
def packet_seconds(spark, sf_dir):
    """Every packet in its stream's time base."""
    p = tables.packets(spark, sf_dir)
    few = p.select("stream_key").distinct()
    params = few.withColumn("stream_index", F.row_number().over(Window.orderBy("stream_key")) - 1).withColumns({"tb_num": F.lit(1).cast("long"), "tb_den": (F.col("stream_index") + 1) * 1000})
    return streams.with_stream_params(p, params).select(F.col("ordinal").alias("event_id"), "stream_index", "seconds")


@query("""
WITH f AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS seen FROM events)
SELECT user_id::VARCHAR AS uri, (dense_rank() OVER (PARTITION BY user_id ORDER BY seen) - 1)::INT AS stream_index, (epoch_us(ts) // 1000 * 90) % 8589934592 AS pts, event_id % 4 = 0 AS keyframe, md5(props || repeat('x', event_id % 400)) AS md5 FROM f""")
def transport_round_trip(spark, sf_dir):
    """Every user's packets muxed into a transport stream of five streams at most, and demuxed."""
    e = tables.table(spark, sf_dir, "events")
    stream = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("event_type")).cast("int")
    payload = F.concat("props", F.repeat(F.lit("x"), (F.col("event_id") % 400).cast("int"))).cast("binary")
    packets = e.select(F.col("user_id").cast("string").alias("uri"), F.col("event_id").alias("at"), stream.alias("stream_index"), (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) * 90).alias("pts"), (F.col("event_id") % 4 == 0).alias("keyframe"), payload.alias("data"))
    return datasource.demux(transport.mux_ts(packets), "mpegts").select("uri", "stream_index", "pts", "keyframe", F.md5("data").alias("md5"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_packets(spark, sf_dir):
    found = streams.first_of(tables.packets(spark, sf_dir), "asset_id", "stream_key", "ordinal")
    return found.select(F.col("asset_id").alias("user_id"), F.col("stream_key").alias("event_type"), F.col("ordinal").alias("event_id"))


@query("SELECT event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 32)::BIGINT AS tick FROM events")
def drained_messages(spark, sf_dir):
    return streams.drain_ticks(tables.packets(spark, sf_dir), "asset_id", "ordinal").select(F.col("ordinal").alias("event_id"), "tick")


@query("""
SELECT user_id, a AS clock_end, v AS picture_end, e AS end_us, CASE WHEN a > v THEN 'view' WHEN a < v THEN 'click' END AS trailing
FROM (SELECT user_id, max(CASE WHEN event_type = 'view' THEN epoch_us(ts) END) AS a, max(CASE WHEN event_type = 'click' THEN epoch_us(ts) END) AS v, max(epoch_us(ts)) AS e FROM events GROUP BY 1)""")
def stream_ends(spark, sf_dir):
    return streams.ends(tables.packets(spark, sf_dir), "asset_id", "view", "click").withColumnRenamed("asset_id", "user_id")


@query("""
SELECT place, p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY CASE p_size % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END, p_type, p_size, p_partkey)::BIGINT AS place FROM part) WHERE place <= 50""")
def bench_listing(spark, sf_dir):
    """The first 50 lines of a benchmark listing."""
    kind = F.element_at(F.array(*map(F.lit, ("Audio", "Video", "Subtitle", "Data"))), F.col("p_size") % 4 + 1)
    part = tables.table(spark, sf_dir, "part").withColumn("media", kind)
    order = registry.bench_order(part, "media", "p_type", "p_size", "p_partkey")
    top = part.orderBy(*order).limit(50)
    return top.select(F.row_number().over(Window.orderBy(*registry.bench_order(top, "media", "p_type", "p_size", "p_partkey"))).cast("long").alias("place"), "p_partkey")


@query("""
SELECT uri, page, 'out/' || p || '-' || printf('%03d', page) || '.png' AS output FROM (SELECT p, uri, unnest(range(a, b + 1))::INT AS page FROM (
  SELECT p_partkey AS p, 'f' || p_partkey || '.pdf' AS uri, p_partkey % 7 AS a, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 7 ELSE p_partkey % 7 + p_size % 5 END AS b FROM part WHERE p_partkey % 4 <> 3))""")
def page_fan_out(spark, sf_dir):
    """Page selectors read from addresses, one numbered output a page; addresses without one name no page."""
    a, b = F.col("p_partkey") % 7, F.col("p_partkey") % 7 + F.col("p_size") % 5
    selector = F.when(F.col("p_partkey") % 4 == 3, F.lit("")).when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("["), a, F.lit("]"))).otherwise(F.concat(F.lit("["), a, F.lit("-"), b, F.lit("]")))
    rows = tables.table(spark, sf_dir, "part").select("p_partkey", text.page_span(F.concat(F.lit("f"), "p_partkey", F.lit(".pdf"), selector)).alias("s"))
    pages = rows.where("s.first IS NOT NULL").select("p_partkey", "s.uri", F.explode(F.sequence("s.first", "s.last")).alias("page"))
    return pages.select("uri", "page", F.concat(F.lit("out/"), "p_partkey", F.lit("-"), text.numbered_name("%03d.png", F.col("page"))).alias("output"))


@query("""
SELECT s_suppkey, 'C:\\\\' || s_name || '\\\\"a"' AS raw, 'C:\\\\\\\\' || s_name || '\\\\\\\\\\"a\\"' AS escaped, ['toggle_pause', 'quit', NULL, 'volume 5'][s_suppkey % 4 + 1] AS command,
  ['none', '7.5 ms', '20 ms'][s_suppkey % 3 + 1] AS latency, ['http://h/a/b.ts', 'http://h/x.ts', 'http://h/c.ts', 'data:,1'][s_suppkey % 4 + 1] AS address FROM supplier""".replace("\\\\", "\\"))
def player_texts(spark, sf_dir):
    """Escapes, key commands, latencies and relative addresses."""
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (F.col("s_suppkey") % len(values)).cast("int"))
    s = tables.table(spark, sf_dir, "supplier").withColumn("raw", F.concat(F.lit("C:\\"), "s_name", F.lit('\\"a"')))
    address = text.resolved_path(F.lit("http://h/a/list.m3u8?q"), pick("./b.ts", "/x.ts", "../c.ts", "data:,1"))
    return s.select("s_suppkey", "raw", text.json_escaped(F.col("raw")).alias("escaped"), text.command_of(pick(" ", "Q", "F1", "UP")).alias("command"), text.latency_text(pick(None, 7.5, 20.4).cast("double")).alias("latency"), address.alias("address"))


# Samples


@query("""
WITH b AS (SELECT event_id, list_transform(string_split(props, ''), lambda c: (ascii(c) - 128) / 128.0) AS s FROM events)
SELECT event_id, len(s)::INT AS n, round(list_sum(s), 5) AS total, round(s[1], 6) AS first FROM b""")
def unsigned_samples(spark, sf_dir):
    """Payload bytes as unsigned 8-bit samples."""
    e = tables.table(spark, sf_dir, "events").select("event_id", audio.samples_of(F.col("props").cast("binary"), F.lit("U8")).alias("s"))
    return e.select("event_id", F.size("s").alias("n"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.get("s", 0).cast("double"), 6).alias("first"))


@query("""
WITH b AS (SELECT event_id, props, unnest(range(3, length(props) + 1)) AS i FROM events WHERE length(props) > 2),
n AS (SELECT event_id, 2 * i AS k, ascii(props[i]) // 16 AS code, ascii(props[2]) AS v FROM b UNION ALL SELECT event_id, 2 * i + 1, ascii(props[i]) % 16, ascii(props[2]) FROM b),
s AS (SELECT event_id, v + sum([-34, -21, -13, -8, -5, -3, -2, -1, 0, 1, 2, 3, 5, 8, 13, 21][code + 1]) OVER (PARTITION BY event_id ORDER BY k) AS v FROM n)
SELECT event_id, count(*)::INT AS n, sum(((v + 128) % 256 + 256) % 256 - 128)::BIGINT AS total FROM s GROUP BY 1""")
def delta_samples(spark, sf_dir):
    """Payloads read as 8-bit delta-coded samples; those of the header alone have none."""
    e = tables.table(spark, sf_dir, "events").where(F.length("props") > 2).select(F.lit("e").alias("uri"), F.lit(0).alias("stream_index"), F.col("event_id").alias("pts"), F.col("props").cast("binary").alias("data"))
    s = codecs.decode_packets(e, codecs.register_all(), "8svx_fib")
    return s.select(F.col("pts").alias("event_id"), F.size("samples").alias("n"), F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 128).cast("long")).alias("total"))


@query("SELECT vec_id, i::INT AS i, embedding[(i % 2) * 32 + i // 2 + 1]::DOUBLE AS value FROM embeddings, range(0, 64) r(i)")
def interleaved_planes(spark, sf_dir):
    v = tables.vectors(spark, sf_dir).select(F.col("frame_no").alias("vec_id"), audio.interleave(F.array(F.slice("samples", 1, 32), F.slice("samples", 33, 32)), F.lit(32)).alias("s"))
    return v.select("vec_id", F.posexplode("s").alias("i", "value"))


@query("""
SELECT kind, n, round(CASE kind WHEN 'sine' THEN sin(2 * pi() * 440 * t) WHEN 'chirp' THEN sin(2 * pi() * t * (440 + 200 * t)) WHEN 'ringmod' THEN sin(2 * pi() * 440 * t) * sin(2 * pi() * 30 * t)
  WHEN 'tremolo' THEN sin(2 * pi() * 440 * t) * (1 - 0.25 * (1 + sin(2 * pi() * 5 * t))) WHEN 'dtmf' THEN 0.5 * sin(2 * pi() * 770 * t) + 0.5 * sin(2 * pi() * 1336 * t)
  WHEN 'multitone' THEN (sin(2 * pi() * 220 * t) + sin(2 * pi() * 440 * t) + sin(2 * pi() * 660 * t)) / 3 WHEN 'impulse' THEN CASE WHEN n % 100 = 0 THEN 1 ELSE 0 END ELSE 0.5 END, 5) AS value
FROM (SELECT event_id AS n, event_id / 8000.0 AS t, unnest(['sine', 'chirp', 'ringmod', 'tremolo', 'dtmf', 'multitone', 'impulse', 'dc']) AS kind FROM events)""")
def generated_audio(spark, sf_dir):
    """Eight generators at the sample of every event."""
    kinds = ("sine", "chirp", "ringmod", "tremolo", "dtmf", "multitone", "impulse", "dc")
    n = F.col("n")
    values = (F.struct(F.lit(kind).alias("kind"), generate.audio_value(kind, n / 8000.0, n, {}).cast("double").alias("value")) for kind in kinds)
    e = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("n"))
    return e.select("n", F.explode(F.array(*values)).alias("g")).select("g.kind", "n", F.round("g.value", 5).alias("value"))


@query("SELECT vec_id AS frame_no, x, y, round(((x + 2 * vec_id) % 16) / 15.0, 6) AS value FROM embeddings, range(0, 16) b(x), range(0, 12) c(y)")
def generated_video(spark, sf_dir):
    """A gradient that moves by two pixels a frame, as long as there are vectors."""
    pixels = tables.vectors(spark, sf_dir).select("frame_no", F.explode(F.sequence(F.lit(0), F.lit(191))).alias("i"))
    pixels = pixels.select("frame_no", (F.col("i") % 16).cast("long").alias("x"), F.floor(F.col("i") / 16).alias("y"))
    return pixels.select("frame_no", "x", "y", F.round(generate.image_value("gradient", F.pmod(F.col("x") + 2 * F.col("frame_no"), F.lit(16)), F.col("y"), 16, 12, {}), 6).alias("value"))


@query("""
WITH v AS (SELECT vec_id // 50 AS file, vec_id, list_transform(embedding, lambda e: least(32767, greatest(-32768, round_even(e::DOUBLE * 32768, 0)))) AS s FROM embeddings)
SELECT 'file ' || file AS uri, count(*)::BIGINT * 64 AS samples, ((count(*) * 64 + 1023) // 1024)::BIGINT AS packets, sum(list_sum(s))::BIGINT AS total FROM v GROUP BY file""")
def wav_round_trip(spark, sf_dir):
    """Frames to 16-bit packets, to a WAV payload a file, back to packets and samples."""
    v = tables.vectors(spark, sf_dir).select(F.concat(F.lit("file "), F.expr("frame_no div 50")).alias("uri"), F.lit(0).alias("stream_index"), F.col("frame_no").alias("pts"), F.col("samples").cast("array<float>").alias("samples"))
    coded = codecs.register_all()
    packets = datasource.demux(datasource.mux_wav(codecs.encode_packets(v, coded, "pcm_s16le"), 1, 48_000), "wav")
    back = codecs.decode_packets(packets, coded, "pcm_s16le")
    sums = back.select("uri", F.size("samples").cast("long").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * 32768).alias("t"))
    return sums.groupBy("uri").agg(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("packets"), F.sum("t").cast("long").alias("total"))


@query("""
WITH e AS (SELECT event_id, event_type, value, (event_id % 7)::DOUBLE AS other FROM events)
SELECT event_id, round(coalesce(corr(value, other) OVER w, 0), 3) AS correlation FROM e WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 16""")
def stereo_correlation(spark, sf_dir):
    """Correlation of two channels over sliding windows of 16 samples."""
    e = tables.packets(spark, sf_dir).select("ordinal", "stream_key", "value", (F.col("ordinal") % 7).cast("double").alias("other"))
    e = blocked.with_halo(streams.number(e, "stream_key", "ordinal", width=blocked.ORDINALS), "n", 15)
    w = Window.partitionBy("stream_key", "_block").orderBy("n").rowsBetween(-15, 0)
    e = e.select("ordinal", "_own", metrics.correlation("value", "other", w).alias("c"), F.count(F.lit(1)).over(w).alias("rows"))
    return e.where("_own AND rows = 16").select(F.col("ordinal").alias("event_id"), F.round(F.coalesce("c", F.lit(0.0)), 3).alias("correlation"))


# Time


@query("""
WITH k AS (SELECT user_id, event_id, epoch_us(ts) AS pts, CASE WHEN event_id % 5 = 0 THEN value END AS v FROM events)
SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pts, event_id ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM k""")
def keyframe_steps(spark, sf_dir):
    p = tables.packets(spark, sf_dir).select("asset_id", "ordinal", "pts", F.when(F.col("ordinal") % 5 == 0, F.col("value")).alias("v"))
    return timeline.interpolate(p, "asset_id", "pts", "v", "ordinal", "step").select(F.col("ordinal").alias("event_id"), "v")


@query("""
WITH k AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 5 = 0 THEN value END AS v, (event_id % 3 - 1) / 1e5 AS m FROM events),
j AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a, first_value(v IGNORE NULLS) OVER f AS z, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS ta, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS tz,
  last_value(CASE WHEN v IS NOT NULL THEN m END IGNORE NULLS) OVER b AS ma, first_value(CASE WHEN v IS NOT NULL THEN m END IGNORE NULLS) OVER f AS mz FROM k
  WINDOW b AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT *, tz - ta AS d, (t - ta) / nullif(tz - ta, 0) AS s FROM j)
SELECT event_id, round(coalesce(v, (2 * s * s * s - 3 * s * s + 1) * a + (s * s * s - 2 * s * s + s) * d * ma + (3 * s * s - 2 * s * s * s) * z + (s * s * s - s * s) * d * mz, a, z), 3) AS v FROM s""")
def keyframe_cubic(spark, sf_dir):
    """Cubic interpolation with a tangent at every key."""
    p = tables.packets(spark, sf_dir).select("asset_id", "ordinal", (F.col("pts") / 1e6).alias("t"), F.when(F.col("ordinal") % 5 == 0, F.col("value")).alias("v"), ((F.col("ordinal") % 3 - 1) / 1e5).alias("m"))
    return timeline.interpolate(p, "asset_id", "t", "v", "ordinal", "cubic", ("m", "m")).select(F.col("ordinal").alias("event_id"), F.round("v", 3).alias("v"))


@query("""
WITH u AS (SELECT vec_id, embedding[1:4]::DOUBLE[] AS p, embedding[5:8]::DOUBLE[] AS q, (vec_id % 5) / 4.0 AS t FROM embeddings),
n AS (SELECT vec_id, t, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) AS a, list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))) AS b FROM u),
d AS (SELECT *, list_dot_product(a, b) AS d FROM n), w AS (SELECT *, acos(least(abs(d), 1)) AS o, CASE WHEN d < 0 THEN -1 ELSE 1 END AS g FROM d),
k AS (SELECT *, CASE WHEN abs(d) > 0.9995 THEN 1 - t ELSE sin((1 - t) * o) / sin(o) END AS wa, CASE WHEN abs(d) > 0.9995 THEN t ELSE sin(t * o) / sin(o) END AS wb FROM w)
SELECT vec_id, round(a[1] * wa + b[1] * g * wb, 5) AS w, round(a[2] * wa + b[2] * g * wb, 5) AS x, round(a[3] * wa + b[3] * g * wb, 5) AS y, round(a[4] * wa + b[4] * g * wb, 5) AS z FROM k""")
def rotations(spark, sf_dir):
    """Arcs between unit quaternions."""
    unit = lambda q: F.transform(q, lambda x: x / F.sqrt(F.aggregate(q, F.lit(0.0), lambda s, y: s + y * y)))
    v = tables.vectors(spark, sf_dir).select(F.col("frame_no").alias("vec_id"), unit(F.slice("samples", 1, 4)).alias("a"), unit(F.slice("samples", 5, 4)).alias("b"))
    v = v.select("vec_id", mesh.slerp(F.col("a"), F.col("b"), (F.col("vec_id") % 5) / 4).alias("q"))
    return v.select("vec_id", *(F.round(F.get("q", i), 5).alias(c) for i, c in enumerate("wxyz")))


# Pictures

_GRID = "g AS (SELECT vec_id, (i % 8)::INT AS x, (i // 8)::INT AS y, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(0, 64) r(i))"


def _grid(spark, sf_dir):
    """Vectors as 8 x 8 planes."""
    v = tables.vectors(spark, sf_dir).select("frame_no", F.posexplode("samples").alias("i", "value"))
    return v.select("frame_no", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), "value")


@query(f"WITH {_GRID} SELECT a.vec_id AS frame_no, a.x, a.y, round(sum(b.v) / 9, 5) AS value FROM g a JOIN g b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3")
def picture_blur(spark, sf_dir):
    out = filters.convolve(_grid(spark, sf_dir), "frame_no", filters.BOX_BLUR)
    return out.withColumn("value", F.round("value", 5))


@query(f"""
WITH {_GRID}, s AS (SELECT a.vec_id, a.x, a.y, sum(b.v * (b.x - a.x) * (2 - abs(b.y - a.y))) AS gx, sum(b.v * (b.y - a.y) * (2 - abs(b.x - a.x))) AS gy FROM g a JOIN g b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3)
SELECT vec_id AS frame_no, x, y, round(sqrt(gx * gx + gy * gy), 4) AS value FROM s""")
def picture_edges(spark, sf_dir):
    return filters.edges(_grid(spark, sf_dir), "frame_no").withColumn("value", F.round("value", 4))


@query(f"WITH {_GRID} SELECT a.vec_id AS frame_no, a.x, a.y, max(b.v) AS dilated, min(b.v) AS eroded FROM g a JOIN g b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3")
def picture_morphology(spark, sf_dir):
    grown, shrunk = (filters.morphology(_grid(spark, sf_dir), "frame_no", kind).withColumnRenamed("value", name) for kind, name in (("dilate", "dilated"), ("erode", "eroded")))
    return grown.join(shrunk, ["frame_no", "x", "y"])


@query(f"WITH {_GRID} SELECT vec_id AS frame_no, x // 2 AS x, y // 2 AS y, round(avg(v), 6) AS value FROM g GROUP BY 1, 2, 3")
def picture_chroma(spark, sf_dir):
    """A chroma plane of 4:4:4 for 4:2:0."""
    return filters.resample_chroma(_grid(spark, sf_dir), "frame_no", 2, 2).withColumn("value", F.round("value", 6))


def _taps(kernel: str, reach: int) -> str:
    """SQL of a resize from 8 x 8 to 5 x 6 under a kernel, @ the distance."""
    return f"""
WITH {_GRID}, n AS (SELECT vec_id, x::INT AS nx, y::INT AS ny, (x + 0.5) * 8 / 5.0 - 0.5 AS fx, (y + 0.5) * 8 / 6.0 - 0.5 AS fy FROM (SELECT DISTINCT vec_id FROM g), range(0, 5) a(x), range(0, 6) b(y)),
t AS (SELECT vec_id, nx, ny, greatest(0, least(7, floor(fx) + i)) AS sx, greatest(0, least(7, floor(fy) + j)) AS sy, {kernel.replace("@", "(fx - floor(fx) - i)")} AS kx, {kernel.replace("@", "(fy - floor(fy) - j)")} AS ky
  FROM n, range({1 - reach}, {reach + 1}) c(i), range({1 - reach}, {reach + 1}) e(j))
SELECT t.vec_id AS frame_no, nx AS x, ny AS y, round(sum(kx * ky * v) / sum(kx * ky), 4) AS value FROM t JOIN g ON g.vec_id = t.vec_id AND g.x = sx AND g.y = sy GROUP BY 1, 2, 3"""


def _resized(kind):
    def run(spark, sf_dir):
        return filters.resize(_grid(spark, sf_dir), "frame_no", 8, 8, 5, 6, kind).withColumn("value", F.round("value", 4))

    run.__name__ = f"resize_{kind}"
    return run


for _kind, _reach, _kernel in (
    ("box", 1, "CASE WHEN @ >= -0.5 AND @ < 0.5 THEN 1.0 ELSE 0.0 END"),
    ("bilinear", 1, "greatest(0, 1 - abs(@))"),
    ("hermite", 1, "greatest(0, (2 * abs(@) - 3) * @ * @ + 1)"),
    ("catmull", 2, "CASE WHEN abs(@) < 1 THEN (9 * abs(@) ** 3 - 15 * @ * @ + 6) / 6 WHEN abs(@) < 2 THEN (-3 * abs(@) ** 3 + 15 * @ * @ - 24 * abs(@) + 12) / 6 ELSE 0 END"),
    ("mitchell", 2, "CASE WHEN abs(@) < 1 THEN (7 * abs(@) ** 3 - 12 * @ * @ + 16 / 3.0) / 6 WHEN abs(@) < 2 THEN (-7 / 3.0 * abs(@) ** 3 + 12 * @ * @ - 20 * abs(@) + 32 / 3.0) / 6 ELSE 0 END"),
    ("lanczos3", 3, "CASE WHEN abs(@) < 1e-9 THEN 1 WHEN abs(@) < 3 THEN 3 * sin(pi() * @) * sin(pi() * @ / 3) / (pi() * @ * pi() * @) ELSE 0 END"),
):
    query(_taps(_kernel, _reach))(_resized(_kind))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: (floor(abs(e::DOUBLE) * 1000)::BIGINT % 256)::DOUBLE) AS s FROM embeddings)
SELECT a.vec_id, round(10 * log10(65025 / (list_sum(list_transform(list_zip(a.s, b.s), lambda z: (z[1] - z[2]) ** 2)) / 64)), 3) AS psnr FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def luma_psnr(spark, sf_dir):
    """Signal to noise of 8-bit planes against the next frame's."""
    v = tables.vectors(spark, sf_dir).select("frame_no", F.transform("samples", lambda e: (F.floor(F.abs(e) * 1000) % 256).cast("double")).alias("s"))
    pairs = v.select(F.col("frame_no").alias("vec_id"), F.col("s").alias("a")).join(v.select((F.col("frame_no") - 1).alias("vec_id"), F.col("s").alias("b")), "vec_id")
    return pairs.select("vec_id", F.round(metrics.psnr(F.col("a"), F.col("b"), 255.0), 3).alias("psnr"))


@query("""
WITH s AS (SELECT p_partkey, p_size / 50.0 AS e, (p_partkey % 11) / 10.0 AS a FROM part), q AS (SELECT *, power(e, 32 / 2523.0) AS p FROM s)
SELECT p_partkey, round(power(greatest(p - 3424 / 4096.0, 0) / (2413 / 128.0 - 2392 / 128.0 * p), 16384 / 2610.0), 6) AS pq,
  round(CASE WHEN e <= 0.5 THEN e * e / 3 ELSE (exp((e - 0.55991073) / 0.17883277) + 0.28466892) / 12 END, 6) AS hlg, round(power(e * (1 - power(0.01, 1 / 2.4)) + power(0.01, 1 / 2.4), 2.4), 6) AS bt1886,
  round(e, 6) AS pq_back, round(e, 6) AS hlg_back, round(CASE WHEN a + 0.5 * (1 - a) > 0 THEN (e * a + 0.25 * 0.5 * (1 - a)) / (a + 0.5 * (1 - a)) ELSE 0 END, 6) AS blended FROM q""")
def transfer_curves(spark, sf_dir):
    """Signals to light by three curves, two of them there and back, and one picture over another."""
    e, a = F.col("p_size") / 50, (F.col("p_partkey") % 11) / 10
    r = lambda c, name: F.round(c, 6).alias(name)
    back = (r(pixel.linear_to_pq(pixel.pq_to_linear(e)), "pq_back"), r(pixel.linear_to_hlg(pixel.hlg_to_linear(e)), "hlg_back"))
    return tables.table(spark, sf_dir, "part").select("p_partkey", r(pixel.pq_to_linear(e), "pq"), r(pixel.hlg_to_linear(e), "hlg"), r(pixel.bt1886_to_linear(e, 0.01), "bt1886"), *back, r(pixel.over(e, a, F.lit(0.25), F.lit(0.5))["value"], "blended"))


@query("""
WITH p AS (SELECT p_partkey, p_size * 40 * 1080 AS c, (p_partkey % 9 + 1) * 100 * 1920 AS s FROM part),
q AS (SELECT p_partkey, c > s AS wide, (200000 * greatest(c, s) + least(c, s)) // (2 * least(c, s)) / 100000.0 AS grown, (100000 * abs(c - s) + greatest(c, s)) // (2 * greatest(c, s)) / 100000.0 AS rest FROM p)
SELECT p_partkey, CASE WHEN wide THEN 1 ELSE grown END::DOUBLE AS sx, CASE WHEN wide THEN grown ELSE 1 END::DOUBLE AS sy, CASE WHEN wide THEN 0 ELSE rest END::DOUBLE AS ox, CASE WHEN wide THEN rest ELSE 0 END::DOUBLE AS oy FROM q""")
def letterbox(spark, sf_dir):
    """Scale and offset as exact fractions, of which half are ties at the digit that they are rounded to."""
    u = pixel.letterbox_fractions(F.col("p_size") * 40, (F.col("p_partkey") % 9 + 1) * 100, F.lit(1920), F.lit(1080))
    shown = (timebase.rounded_fraction(F.col("u")[c]["num"], F.col("u")[c]["den"], 5).alias(c) for c in ("sx", "sy", "ox", "oy"))
    return tables.table(spark, sf_dir, "part").select("p_partkey", u.alias("u")).select("p_partkey", *shown)


@query("""
SELECT p_partkey, array_to_string(list_transform(range(0, CASE WHEN length(p_name) >= 3 THEN least(4, (length(p_name) - 3) // 5 + 1) ELSE 0 END), lambda r: substr(p_name, r * 5 + 1, 3)), '') AS tight FROM part""")
def tight_planes(spark, sf_dir):
    """Planes of 3 x 4 without the padding of rows of 5."""
    tight = pixel.plane_tight(F.col("p_name").cast("binary"), F.lit(5), F.lit(3), F.lit(4))
    return tables.table(spark, sf_dir, "part").select("p_partkey", tight.cast("string").alias("tight"))


@query("SELECT c_custkey, round(greatest(0, least(1, (c_custkey % 101) / 100.0 + (c_custkey % 41 - 20) / 100.0)), 6) AS level FROM customer")
def volume_levels(spark, sf_dir):
    level = timebase.volume((F.col("c_custkey") % 101) / 100, F.col("c_custkey") % 41 - 20)
    return tables.table(spark, sf_dir, "customer").select("c_custkey", F.round(level, 6).alias("level"))


# Geometry

_VERTICES = "t AS (SELECT vec_id, i::INT AS vtx, embedding[i * 3 + 1]::DOUBLE AS x, embedding[i * 3 + 2]::DOUBLE AS y, embedding[i * 3 + 3]::DOUBLE AS z FROM embeddings, range(0, 21) r(i))"


def _vertices(spark, sf_dir):
    v = tables.vectors(spark, sf_dir).select(F.concat(F.lit("m"), "frame_no").alias("uri"), "samples", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("vtx"))
    return v.select("uri", F.lit(0).alias("prim_id"), F.col("vtx").cast("long").alias("vtx"), *(F.get("samples", F.col("vtx") * 3 + n).cast("float").alias(c) for n, c in enumerate("xyz")), F.lit(None).cast("string").alias("material"))


@query(f"WITH {_VERTICES} SELECT k AS kind, 'm' || vec_id AS uri, vtx, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM t, (SELECT unnest(['stl', 'obj']) AS k)")
def mesh_round_trip(spark, sf_dir):
    """Seven triangles a mesh through two formats and back."""
    out = None
    for kind in ("stl", "obj"):
        back = meshes.decode(meshes.encode(_vertices(spark, sf_dir), kind), kind)
        rows = back.select(F.lit(kind).alias("kind"), "uri", F.col("vtx").cast("int").alias("vtx"), *(F.round(F.col(c).cast("double"), 6).alias(c) for c in "xyz"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""
WITH {_VERTICES}, f AS (SELECT vec_id, vtx // 3 AS t, max(CASE WHEN vtx % 3 = 0 THEN x END) AS x0, max(CASE WHEN vtx % 3 = 0 THEN y END) AS y0, max(CASE WHEN vtx % 3 = 0 THEN z END) AS z0, max(CASE WHEN vtx % 3 = 1 THEN x END) AS x1, max(CASE WHEN vtx % 3 = 1 THEN y END) AS y1,
  max(CASE WHEN vtx % 3 = 1 THEN z END) AS z1, max(CASE WHEN vtx % 3 = 2 THEN x END) AS x2, max(CASE WHEN vtx % 3 = 2 THEN y END) AS y2, max(CASE WHEN vtx % 3 = 2 THEN z END) AS z2 FROM t GROUP BY 1, 2),
c AS (SELECT vec_id, t, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS a, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS b, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS d FROM f)
SELECT 'm' || vec_id AS uri, vtx, round(a / sqrt(a * a + b * b + d * d), 4) AS nx, round(b / sqrt(a * a + b * b + d * d), 4) AS ny, round(d / sqrt(a * a + b * b + d * d), 4) AS nz FROM t JOIN c USING (vec_id) WHERE vtx // 3 = c.t""")
def mesh_normals(spark, sf_dir):
    out = meshes.normals(_vertices(spark, sf_dir))
    return out.select("uri", F.col("vtx").cast("int").alias("vtx"), *(F.round(c, 4).alias(c) for c in ("nx", "ny", "nz")))


@query("""
WITH RECURSIVE n AS (SELECT vec_id, j, CASE WHEN j > 0 THEN (j - 1) // 2 END AS parent, embedding[j + 1]::DOUBLE AS a, embedding[j + 9]::DOUBLE AS tx, embedding[j + 17]::DOUBLE AS ty FROM embeddings, range(0, 8) r(j)),
w AS (SELECT vec_id, j, a, tx, ty FROM n WHERE parent IS NULL UNION ALL SELECT n.vec_id, n.j, w.a + n.a, w.tx + cos(w.a) * n.tx - sin(w.a) * n.ty, w.ty + sin(w.a) * n.tx + cos(w.a) * n.ty FROM w JOIN n ON n.vec_id = w.vec_id AND n.parent = w.j),
v AS (SELECT vec_id, i, embedding[25 + 3 * i]::DOUBLE AS x, embedding[26 + 3 * i]::DOUBLE AS y, embedding[27 + 3 * i]::DOUBLE AS z, abs(embedding[i + 1]::DOUBLE) AS w1, greatest(embedding[i + 2]::DOUBLE, 0) AS w2 FROM embeddings, range(0, 13) r(i)),
f AS (SELECT vec_id, i, x, y, z, i % 8 AS j, w1 / (w1 + w2) AS k FROM v UNION ALL SELECT vec_id, i, x, y, z, (i + 3) % 8, w2 / (w1 + w2) FROM v)
SELECT vec_id, i AS vtx, round(sum(k * (cos(a) * (x - 0.1 * f.j) - sin(a) * y + tx)), 5) AS x, round(sum(k * (sin(a) * (x - 0.1 * f.j) + cos(a) * y + ty)), 5) AS y, round(sum(k * z), 5) AS z FROM f JOIN w USING (vec_id, j) GROUP BY 1, 2""")
def skinned_vertices(spark, sf_dir):
    """Thirteen vertices a mesh, each moved by two of eight joints of a tree; weights below zero count as none."""
    v = tables.vectors(spark, sf_dir).select(F.col("frame_no").alias("vec_id"), "samples")
    e = lambda i: F.get("samples", i)
    zero, one = F.lit(0.0), F.lit(1.0)
    j = F.col("node")
    nodes = v.select("vec_id", "samples", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("node"))
    c, s = F.cos(e(j)), F.sin(e(j))
    matrix = F.array(c, s, zero, zero, -s, c, zero, zero, zero, zero, one, zero, e(j + 8), e(j + 16), zero, one)
    inverse = F.array(*(F.lit(x) for x in skeleton.IDENTITY[:12]), j * -0.1, zero, zero, one)
    nodes = nodes.select("vec_id", "node", F.when(j > 0, F.floor((j - 1) / 2).cast("int")).alias("parent"), matrix.alias("matrix"), inverse.alias("inverse"))
    joints = skeleton.world_matrices(nodes, "vec_id", rounds=2).join(nodes.select("vec_id", "node", "inverse"), ["vec_id", "node"])
    i = F.col("vtx")
    points = v.select("vec_id", "samples", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("vtx"))
    pairs = F.explode(F.array(F.struct((i % 8).alias("joint"), F.abs(e(i)).alias("weight")), F.struct(((i + 3) % 8).alias("joint"), e(i + 1).alias("weight"))))
    influences = points.select("vec_id", "vtx", pairs.alias("p")).select("vec_id", "vtx", "p.*")
    vertices = points.select("vec_id", "vtx", *(e(i * 3 + 24 + k).alias(c) for k, c in enumerate("xyz")))
    moved = skeleton.skinned(vertices, influences, joints, "vec_id", "vtx")
    return moved.select("vec_id", F.col("vtx").cast("long").alias("vtx"), *(F.round(c, 5).alias(c) for c in "xyz"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 1 END / 100.0 AS metres, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 7 END AS weight FROM part""")
def scene_units(spark, sf_dir):
    """Units of a scene's properties, and weights that a node may override."""
    named = F.when(F.col("p_partkey") % 3 == 0, "UnitScaleFactor").otherwise("UpAxis")
    p = tables.table(spark, sf_dir, "part").withColumn("properties", F.array(F.struct(F.lit("Other").alias("name"), F.lit(9.0).alias("value")), F.struct(named.alias("name"), F.col("p_size").cast("double").alias("value"))))
    weights = mesh.morph_weights(F.when(F.col("p_partkey") % 2 == 0, F.array("p_size")), F.array(F.lit(7)))
    return p.select("p_partkey", mesh.fbx_metres(F.col("properties")).alias("metres"), F.get(weights, 0).alias("weight"))


# Subtitles

_CUES = "c AS (SELECT conv_id::VARCHAR AS uri, conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS cue_no, 'turn ' || role || ' ' || (length(text) % 90) AS line FROM conversations)"


def _cues(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return c.select(F.col("conv_id").cast("string").alias("uri"), number.alias("cue_no"), F.concat(F.lit("turn "), "role", F.lit(" "), F.length("text") % 90).alias("line"))


def _files(rows, line):
    """One text a uri from its lines in order of cue_no."""
    parts = rows.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("cue_no", line.alias("line")))).alias("c"))
    return parts.select("uri", F.array_join(F.transform("c", lambda x: x["line"]), "\r\n").alias("text"))


@query(f"WITH {_CUES} SELECT k AS kind, uri, cue_no, cue_no * 3500000 AS start_us, cue_no * 3500000 + 1250000 AS end_us, line AS text FROM c, (SELECT unnest(['subrip', 'webvtt']) AS k)")
def subtitle_round_trip(spark, sf_dir):
    """Cues written as two formats and read again, with a byte order mark and CRLF in between."""
    rows = _cues(spark, sf_dir).withColumns({"start_us": F.col("cue_no") * 3_500_000, "end_us": F.col("cue_no") * 3_500_000 + 1_250_000}).withColumnRenamed("line", "text")
    out = None
    for kind in ("subrip", "webvtt"):
        files = subtitles.write_cues(rows, kind).withColumn("text", F.concat(F.lit("\ufeff"), F.replace("text", F.lit("\n"), F.lit("\r\n"))))
        back = subtitles.parse_arrow_cues(files).withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


@query(f"""
WITH {_CUES} SELECT 'microdvd' AS kind, uri, cue_no, cue_no * 4000000 AS start_us, cue_no * 4000000 + 2000000 AS end_us, line AS text FROM c
UNION ALL SELECT 'mpl2', uri, cue_no, cue_no * 4000000, cue_no * 4000000 + 1500000, line FROM c
UNION ALL SELECT 'vplayer', uri, cue_no, cue_no * 4000000, cue_no * 4000000 + 4000000, line FROM c
UNION ALL SELECT 'mpsub', uri, cue_no, cue_no * 3000000 - 2000000, cue_no * 3000000, line FROM c""")
def subtitle_lines(spark, sf_dir):
    """Frames, tenths, open ends and relative starts."""
    c = _cues(spark, sf_dir)
    n, line = F.col("cue_no"), F.col("line")
    clock = F.format_string("%02d:%02d:%02d:", F.floor(n * 4 / 3600), F.floor(n * 4 / 60) % 60, n * 4 % 60)
    read = {
        "microdvd": subtitles.parse_microdvd(_files(c, F.concat(F.lit("{"), n * 100, F.lit("}{"), n * 100 + 50, F.lit("}"), line))),
        "mpl2": subtitles.parse_mpl2(_files(c, F.concat(F.lit("["), n * 40, F.lit("]["), n * 40 + 15, F.lit("]"), line))),
        "vplayer": subtitles.parse_vplayer(_files(c, F.concat(clock, line))),
        "mpsub": subtitles.parse_mpsub(_files(c, F.concat(F.lit("1 2\n"), line, F.lit("\n")))),
    }
    out = None
    for kind, rows in read.items():
        rows = rows.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


_PAIRS = ("srt_to_webvtt", "webvtt_to_srt", "srt_to_ass", "webvtt_to_ass", "ass_to_srt", "ass_to_webvtt")


@query(f"""
WITH {_CUES} SELECT k AS kind, uri, cue_no, cue_no * 4000000 AS start_us, cue_no * 4000000 + 2000000 AS end_us, line || chr(10) || 'and "more", <' || role || '>' AS text FROM (SELECT c.*, role FROM c JOIN conversations v ON v.conv_id = c.conv_id AND v.turn = c.turn), (SELECT unnest(['subviewer', 'ttml', 'aqtitle', 'pjs', 'microdvd', 'mpl2']) AS k)""")
def subtitle_formats(spark, sf_dir):
    """Cues of two lines written in six more formats and read again."""
    c = tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("uri"), F.col("turn"), F.col("role"))
    number = F.row_number().over(Window.partitionBy("uri").orderBy("turn")).cast("long")
    roles = c.select("uri", number.alias("cue_no"), "role")
    rows = _cues(spark, sf_dir).join(roles, ["uri", "cue_no"])
    text = F.concat("line", F.lit('\nand "more", <'), "role", F.lit(">"))
    rows = rows.select("uri", "cue_no", (F.col("cue_no") * 4_000_000).alias("start_us"), (F.col("cue_no") * 4_000_000 + 2_000_000).alias("end_us"), text.alias("text"))
    out = None
    for kind in ("subviewer", "ttml", "aqtitle", "pjs", "microdvd", "mpl2"):
        back = subtitles.PARSERS[kind](subtitles.write_cues(rows, kind)).withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


@query(f"""
WITH {_CUES} SELECT k AS pair, uri, cue_no, cue_no * 3500000 AS start_us, cue_no * 3500000 + 1250000 AS end_us, '<i>' || line || '</i>' || chr(10) || 'and, <b>more</b>' AS text FROM c, (SELECT unnest([{", ".join(f"'{p}'" for p in _PAIRS)}]) AS k)""")
def subtitle_pairs(spark, sf_dir):
    """Six conversions between three formats, markup and line breaks kept."""
    rows = _cues(spark, sf_dir).select("uri", "cue_no", (F.col("cue_no") * 3_500_000).alias("start_us"), (F.col("cue_no") * 3_500_000 + 1_250_000).alias("end_us"), F.concat(F.lit("<i>"), "line", F.lit("</i>\nand, <b>more</b>")).alias("text"))
    names, out = {"srt": "subrip", "webvtt": "webvtt", "ass": "ass"}, None
    for pair in _PAIRS:
        source, target = (names[n] for n in pair.split("_to_"))
        back = subtitles.PARSERS[target](subtitles.converted(subtitles.write_cues(rows, source), source, target)).withColumn("pair", F.lit(pair))
        out = back if out is None else out.unionByName(back)
    return out


_ATTRIBUTES = "a AS (SELECT event_id, 'position' AS attribute FROM events UNION ALL SELECT event_id, 'material' FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'weights' FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, 'extras' FROM events WHERE event_id % 3 = 0)"


def _elements(spark, sf_dir):
    """Events as elements: a number, a text, a list and their properties as side data."""
    e = tables.table(spark, sf_dir, "events")
    value = lambda c: F.parse_json(F.to_json(F.struct(c.alias("v"))))
    when = lambda every, name, c: F.when(F.col("event_id") % every == 0, F.create_map(F.lit(name), c)).otherwise(F.create_map().cast("map<string, variant>"))
    maps = (when(1, "position", value(F.col("value"))), when(2, "material", value(F.col("event_type"))), when(5, "weights", value(F.array("value", "value"))), when(3, "extras", F.parse_json("props")))
    return e.select("event_id", F.map_concat(*maps).alias("attributes"))


@query(f"""
WITH {_ATTRIBUTES}, n AS (SELECT attribute, count(*) AS n FROM a GROUP BY 1), s AS (SELECT unnest(['stl', 'obj', 'gltf']) AS sink),
k AS (SELECT *, sink = 'gltf' OR attribute = 'position' OR sink = 'obj' AND attribute = 'material' AS keeps FROM n, s)
SELECT sink, attribute, CASE WHEN keeps THEN n ELSE 0 END AS kept, CASE WHEN keeps THEN 0 ELSE n END AS dropped FROM k""")
def extras_matrix(spark, sf_dir):
    """What three mesh formats keep and drop of the attributes that elements bring."""
    return extras.losses(_elements(spark, sf_dir))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (props::JSON->>'$.k')::INT END AS k, CASE WHEN event_id % 2 = 0 THEN event_type END AS material FROM events")
def extras_kept(spark, sf_dir):
    """Side data after a format that keeps it, and after one that keeps the material only."""
    e = _elements(spark, sf_dir)
    rich, plain = extras.through(e, "gltf"), extras.through(e, "obj")
    k = F.variant_get(F.try_element_at("attributes", F.lit("extras")), "$.k", "int")
    material = F.variant_get(F.try_element_at("attributes", F.lit("material")), "$.v", "string")
    lost = F.try_element_at("attributes", F.lit("extras")).isNull()
    return rich.select("event_id", k.alias("k")).join(plain.where(lost).select("event_id", material.alias("material")), "event_id")
