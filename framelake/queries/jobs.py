"""The JSON job front end over the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import tables
from ..operators import blocked
from ..plans.convert import parse_convert
from ..plans.job import Job, compile_job, decode_payloads
from .registrar import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


def read_packets(spark, uri):
    """``events`` as packets of two media types and their codecs."""
    video = F.col("stream_key") == "click"
    return tables.packets(spark, uri.removeprefix("packets:")).withColumns({"media_type": F.when(video, "Video").otherwise("Audio"), "codec_id": F.when(video, "vp8").otherwise("pcm_s16le")})


@query("SELECT event_type AS stream_key, event_id AS ordinal, epoch_us(ts) AS pts, strlen(props)::BIGINT AS size FROM events")
def job_graph_run(spark, sf_dir):
    """A job that copies every stream to the null sink gives what a plain selection gives."""
    job = Job.from_json(json.dumps({"@null": {"all": [{"from": f"packets:{sf_dir}"}]}}))
    return compile_job(spark, job, read_packets)["@null"].select("stream_key", "ordinal", "pts", "size")


@query("""
SELECT 0 AS track_no, event_id AS ordinal, round(value * power(10, -3 / 20.0), 6) AS value, 'pcm_s16le' AS codec_id FROM events WHERE event_type <> 'click'
UNION ALL SELECT 1, event_id, round(value, 6), 'vp8' FROM events WHERE event_type = 'click' AND event_id % 4 = 0""")
def job_filter_tracks(spark, sf_dir):
    """An alias shared by two tracks: audio with a gain, video keyframes copied in the codec that they have."""
    job = Job.from_json(json.dumps({
        "@in": {"all": [{"from": f"packets:{sf_dir}"}]},
        "@out": {"audio": [{"filter": "volume", "params": {"gain_db": -3}, "input": {"from": f"packets:{sf_dir}"}}], "video": [{"codec": "vp8", "filter": "keyframes", "input": {"from": f"packets:{sf_dir}"}}]},
    }))
    out = compile_job(spark, job, read_packets)["@out"]
    return out.select("track_no", "ordinal", F.round("value", 6).alias("value"), "codec_id")


def _frames(spark, uri):
    """``embeddings`` as sources: pixels of 8 x 8 pictures, or audio frames of 64 samples."""
    kind, sf_dir = uri.split(":", 1)
    v = tables.vectors(spark, sf_dir)
    if kind == "frames":
        return v.select("frame_no", (F.col("frame_no") * 64).alias("pts"), "samples")
    level = lambda s, i: (F.floor(F.abs(F.get(s, i)) * 1000) % 256).cast("int")
    p = v.select("frame_no", "samples", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    return p.select("frame_no", (F.col("i") % 5).alias("x"), F.floor(F.col("i") / 5).cast("int").alias("y"), F.lit("rgb24").alias("pixel_format"), F.array(*(level("samples", F.col("i") * 3 + n) for n in range(3))).alias("stored"))


_PIXELS = """p AS (SELECT vec_id AS frame_no, i, (i % 5)::INT AS x, (i // 5)::INT AS y, list_transform(embedding[3 * i + 1:3 * i + 3], lambda e: (floor(abs(e::DOUBLE) * 1000)::BIGINT % 256) / 255.0) AS c FROM embeddings, range(0, 20) r(i)),
l AS (SELECT *, 0.2126 * c[1] + (1 - 0.2126 - 0.0722) * c[2] + 0.0722 * c[3] AS luma FROM p),
s AS (SELECT *, round(luma * 255)::INT AS sy, least(255, greatest(0, round(((c[3] - luma) / (2 * (1 - 0.0722)) + 0.5) * 255)))::INT AS su, least(255, greatest(0, round(((c[1] - luma) / (2 * (1 - 0.2126)) + 0.5) * 255)))::INT AS sv FROM l)"""


@query(f"""
WITH {_PIXELS}
SELECT 0 AS track_no, frame_no, x, y, 'yuv444p' AS pixel_format, sy AS c0, su AS c1, sv AS c2 FROM s
UNION ALL SELECT 1, frame_no, x, y, 'gray8', sy, NULL, NULL FROM s
UNION ALL SELECT 2, frame_no, x, y, 'bgra', round(c[3] * 255)::INT, round(c[2] * 255)::INT, round(c[1] * 255)::INT FROM s
UNION ALL SELECT 3, frame_no, x, y, 'yuv420p', sy, round(avg(su) OVER q)::INT, round(avg(sv) OVER q)::INT FROM s WINDOW q AS (PARTITION BY frame_no, x // 2, y // 2)""")
def job_convert(spark, sf_dir):
    """Pixels converted by four convert nodes, chroma shared in the last."""
    tracks = [{"convert": name, "input": {"from": f"pixels:{sf_dir}"}} for name in ("yuv444p", "gray8", "bgra", "yuv420p")]
    out = compile_job(spark, Job.from_json(json.dumps({"@out": {"video": tracks}})), _frames)["@out"]
    return out.select("track_no", "frame_no", "x", "y", "pixel_format", *(F.get("stored", i).alias(f"c{i}") for i in range(3)))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS s FROM embeddings),
q AS (SELECT vec_id, list_transform(s, lambda e: least(32767, greatest(-32768, round_even(e * 32768, 0)))) AS s16, list_transform(s, lambda e: least(255, greatest(0, round_even(e * 128 + 128, 0))) - 128) AS u8 FROM v)
SELECT vec_id AS frame_no, 'pcm_s16le' AS codec_id, 128 AS bytes, list_sum(s16)::BIGINT AS total, list_max(s16)::BIGINT AS top FROM q
UNION ALL SELECT vec_id, 'pcm_u8', 64, list_sum(u8)::BIGINT, list_max(u8)::BIGINT FROM q""")
def job_transcode(spark, sf_dir):
    """Audio frames encoded by a job in two codecs, and what decoding the payloads gives."""
    tracks = [{"codec": codec, "from": f"frames:{sf_dir}"} for codec in ("pcm_s16le", "pcm_u8")]
    coded = compile_job(spark, Job.from_json(json.dumps({"@out": {"audio": tracks}})), _frames)["@out"]
    back = decode_payloads(coded.withColumn("bytes", F.octet_length("data")))
    steps = F.transform("samples", lambda s: F.round(s * F.when(F.col("codec_id") == "pcm_u8", 128).otherwise(32768)).cast("long"))
    return back.select("frame_no", "codec_id", "bytes", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max(steps).alias("top"))


@query("""
WITH g AS (SELECT event_type AS stream_key, event_id AS ordinal, value * 0.5 AS value FROM events)
SELECT stream_key, ordinal, round(value + 0.25 * coalesce(lag(value, 3) OVER (PARTITION BY stream_key ORDER BY ordinal), 0), 6) AS value FROM g""")
def job_filter_chain(spark, sf_dir):
    """A gain, then an echo of three samples."""
    tree = {"filter": "echo", "params": {"delay": 3, "mix": 0.25}, "input": {"filter": "volume", "params": {"scale": 0.5}, "input": {"from": f"packets:{sf_dir}"}}}
    out = compile_job(spark, Job.from_json(json.dumps({"@out": {"all": [tree]}})), read_packets)["@out"]
    return out.select("stream_key", "ordinal", F.round("value", 6).alias("value"))


@query("""
SELECT 'a.mkv' AS output, 0 AS track_no, event_type AS stream_key, count(*)::BIGINT AS n, round(sum(value), 3) AS total FROM events WHERE event_type <> 'click' GROUP BY 3
UNION ALL SELECT 'b.mkv', 0, event_type, count(*)::BIGINT, round(sum(value * 2), 3) FROM events WHERE event_type <> 'click' GROUP BY 3
UNION ALL SELECT 'b.mkv', 1, event_type, count(*)::BIGINT, round(sum(value), 3) FROM events WHERE event_type = 'click' AND event_id % 4 = 0 GROUP BY 3""")
def job_fan_out(spark, sf_dir):
    """Two outputs from one alias: every output is a plan of its own over one scan."""
    source = {"from": "@in"}
    job = Job.from_json(json.dumps({
        "@in": {"all": [{"from": f"packets:{sf_dir}"}]},
        "a.mkv": {"audio": [source]},
        "b.mkv": {"audio": [{"filter": "volume", "params": {"scale": 2}, "input": source}], "video": [{"filter": "keyframes", "input": source}]},
    }))
    built = compile_job(spark, job, read_packets)
    sums = [df.groupBy(F.lit(name).alias("output"), "track_no", "stream_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")) for name, df in built.items()]
    return sums[0].unionByName(sums[1])


_KERNEL = "k AS (SELECT t - 3 AS d, exp(-0.5 * ((t - 3) / 0.8) * ((t - 3) / 0.8)) AS w FROM range(0, 7) r(t)), kn AS (SELECT d, w / (SELECT sum(w) FROM k) AS w FROM k)"


@query(f"""
WITH g AS (SELECT vec_id AS f, (i % 8)::INT AS x, (i // 8)::INT AS y, (floor(abs(embedding[i + 1]::DOUBLE) * 1000)::BIGINT % 256) / 255.0 AS v FROM embeddings, range(0, 64) r(i)), {_KERNEL},
r AS (SELECT f, x // 2 AS x, y // 2 AS y, avg(v) AS v FROM g GROUP BY 1, 2, 3),
s AS (SELECT a.f, a.x, a.y, sum(b.v * (b.x - a.x) * (2 - abs(b.y - a.y))) AS gx, sum(b.v * (b.y - a.y) * (2 - abs(b.x - a.x))) AS gy FROM r a JOIN r b ON a.f = b.f AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3),
e AS (SELECT f, x, y, sqrt(gx * gx + gy * gy) AS v FROM s),
h AS (SELECT e.f, e.x + d AS x, e.y, sum(v * w) AS v FROM e, kn WHERE e.x + d BETWEEN 0 AND 3 GROUP BY 1, 2, 3), b AS (SELECT h.f, h.x, h.y + d AS y, sum(v * w) AS v FROM h, kn WHERE h.y + d BETWEEN 0 AND 3 GROUP BY 1, 2, 3),
d AS (SELECT *, (xor(x, y) & 1) * 32 + (y & 1) * 16 + ((xor(x, y) >> 1) & 1) * 8 + ((y >> 1) & 1) * 4 + ((xor(x, y) >> 2) & 1) * 2 + ((y >> 2) & 1) AS rank FROM b)
SELECT f AS frame_no, x, y, least(4, floor(v * 4 + (rank + 0.5) / 64)) / 4.0 AS value FROM d""")
def convert_command(spark, sf_dir):
    """A command of five operations over planes of 8 x 8."""
    job = parse_convert(f"levels:{sf_dir} -resize 4x4 -edge 1 -blur 0x0.8 -dither ordered -colors 5 -strip @null", (8, 8))
    return compile_job(spark, job, _planes)["@null"].select("frame_no", "x", "y", "value")


def _planes(spark, uri):
    v = tables.vectors(spark, uri.removeprefix("levels:")).select("frame_no", F.posexplode("samples").alias("i", "v"))
    return v.select("frame_no", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), ((F.floor(F.abs("v") * 1000) % 256) / 255).alias("value"))


@query("""
WITH s AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1)::BIGINT AS n, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(0, 64) r(i)),
f AS (SELECT label, n // 16 - k AS frame, n - (n // 16 - k) * 16 AS place, v FROM s, range(0, 2) r(k) WHERE n // 16 - k >= 0),
w AS (SELECT label, frame, b AS bin, sum(v * (0.5 - 0.5 * cos(2 * pi() * place / 31)) * cos(2 * pi() * b * place / 32)) AS re, sum(v * (0.5 - 0.5 * cos(2 * pi() * place / 31)) * sin(2 * pi() * b * place / 32)) AS im FROM f, range(0, 17) r(b) GROUP BY 1, 2, 3)
SELECT 'bins' AS port, label::VARCHAR AS stream, frame, bin::BIGINT AS bin, round(re * re + im * im, 4) AS number FROM w
UNION ALL SELECT 'samples', label::VARCHAR, n, NULL, round(v, 4) FROM s""")
def spectrogram_ports(spark, sf_dir):
    """One filter with two of its outputs in one job: powers, and the samples as they came; every label is a stream."""

    def read(spark, uri):
        v = tables.vectors(spark, uri).select("stream_index", "frame_no", F.posexplode("samples").alias("i", "value"))
        numbered = blocked.running(v, "stream_index", ["frame_no", "i"], 256, ordinal=("count_before", F.lit(1)))
        return numbered.select(F.col("stream_index").cast("string").alias("stream_key"), "ordinal", "value")

    tree = {"filter": "spectrogram", "params": {"width": 32, "hop": 16}, "input": {"from": sf_dir}}
    built = compile_job(spark, Job.from_json(json.dumps({"@out": {"audio": [tree, tree | {"port": "samples"}]}})), read)["@out"]
    bins = built.where("track_no = 0").select(F.lit("bins").alias("port"), F.col("stream_key").alias("stream"), "frame", F.col("bin").cast("long").alias("bin"), F.round("power", 4).alias("number"))
    samples = built.where("track_no = 1").select(F.lit("samples").alias("port"), F.col("stream_key").alias("stream"), F.col("ordinal").alias("frame"), F.lit(None).cast("long").alias("bin"), F.round("value", 4).alias("number"))
    return bins.unionByName(samples)


#: The middle weights as the same binary fractions that the columns have.
_DEEP = """p AS (SELECT vec_id AS frame_no, (i % 5)::INT AS x, (i // 5)::INT AS y, list_transform(embedding[3 * i + 1:3 * i + 3], lambda e: (floor(abs(e::DOUBLE) * 1000)::BIGINT % 256) / 255.0) AS c FROM embeddings, range(0, 20) r(i)),
l AS (SELECT *, 0.2627 * c[1] + 0.678::DOUBLE * c[2] + 0.0593 * c[3] AS a, 0.299 * c[1] + 0.5870000000000001::DOUBLE * c[2] + 0.114 * c[3] AS b FROM p),
d AS (SELECT *, round(64 + 876 * a)::INT * 64 AS dy, round(512 + 896 * (c[3] - a) / (2 * (1 - 0.0593)))::INT * 64 AS du, round(512 + 896 * (c[1] - a) / (2 * (1 - 0.2627)))::INT * 64 AS dv,
  round(255 * b)::INT AS sy, least(255, greatest(0, round(255 * ((c[3] - b) / 1.772::DOUBLE + 0.5))))::INT AS su, least(255, greatest(0, round(255 * ((c[1] - b) / 1.4020000000000001::DOUBLE + 0.5))))::INT AS sv FROM l)"""


@query(f"""
WITH {_DEEP}
SELECT 0 AS track_no, frame_no, x, y, 'p010le' AS pixel_format, dy AS c0, round(avg(du) OVER q / 64)::INT * 64 AS c1, round(avg(dv) OVER q / 64)::INT * 64 AS c2 FROM d WINDOW q AS (PARTITION BY frame_no, x // 2, y // 2)
UNION ALL SELECT 1, frame_no, x, y, 'nv16', sy, round(avg(su) OVER q)::INT, round(avg(sv) OVER q)::INT FROM d WINDOW q AS (PARTITION BY frame_no, x // 2, y)
UNION ALL SELECT 2, frame_no, x, y, 'yuv440p', sy, round(avg(su) OVER q)::INT, round(avg(sv) OVER q)::INT FROM d WINDOW q AS (PARTITION BY frame_no, x, y // 2)""")
def job_convert_deep(spark, sf_dir):
    """Ten bits in limited range under one matrix, and two semi-planar or tall layouts under another."""
    source = {"from": f"pixels:{sf_dir}"}
    tracks = [{"convert": "p010le", "matrix": "bt2020", "range": "limited", "input": source}, *({"convert": name, "matrix": "bt601", "input": source} for name in ("nv16", "yuv440p"))]
    out = compile_job(spark, Job.from_json(json.dumps({"@out": {"video": tracks}})), _frames)["@out"]
    return out.select("track_no", "frame_no", "x", "y", "pixel_format", *(F.get("stored", i).alias(f"c{i}") for i in range(3)))
