"""Audio metrics, downmix, routing and resampling; ``embeddings`` stand for frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..functions import audio
from ..functions.digest import stream_digests
from ..operators import metrics
from .registrar import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

_V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings)"


def _pairs(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    a = v.select(F.col("frame_no").alias("vec_id"), F.col("samples").alias("a"))
    b = v.select((F.col("frame_no") - 1).alias("vec_id"), F.col("samples").alias("b"))
    return a.join(b, "vec_id")


@query(f"""
WITH {_V}, p AS (SELECT a.vec_id, a.s AS a, b.s AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(a)), 5) AS rms FROM p""")
def audio_rms(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(metrics.rms(F.col("a"), F.col("b")), 5).alias("rms"))


@query(f"""
WITH {_V}, p AS (SELECT a.vec_id, a.s AS a, b.s AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(10 * log10(1.0 / (list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(a))), 4) AS psnr FROM p""")
def audio_psnr(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(metrics.psnr(F.col("a"), F.col("b"), 1.0), 4).alias("psnr"))


@query(f"""
WITH {_V}, p AS (SELECT a.vec_id, a.s AS a, b.s AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
r AS (SELECT vec_id, lag::INT AS lag, sqrt(list_sum(list_transform(list_zip(a[lag + 1:], b[1:64 - lag]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / (64 - lag)) AS rms FROM p, range(0, 9) g(lag))
SELECT vec_id, arg_min(lag, rms) AS lag, round(min(rms), 5) AS rms FROM r GROUP BY 1""")
def best_lag(spark, sf_dir):
    """The best of nine lags, the search's own window, for every frame against the next."""
    found = metrics.best_lag(_pairs(spark, sf_dir), "a", "b", 8)
    return found.select("vec_id", "lag", F.round("rms", 5).alias("rms"))


_CHANNELS = ("FrontLeft", "FrontRight", "FrontCenter", "LowFrequency", "BackLeft", "BackRight", "SideLeft", "SideRight")


def _surround(spark, sf_dir):
    """Vectors as 8 interleaved channels of 8 samples: one row a sample."""
    v = tables.vectors(spark, sf_dir).select(F.col("frame_no").alias("vec_id"), "samples", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    return v.select("vec_id", "i", *(F.get("samples", F.col("i") * 8 + n).alias(name) for n, name in enumerate(_CHANNELS)))


_SQL_CHANNELS = "c AS (SELECT vec_id, i::INT AS i, s[i * 8 + 1] AS fl, s[i * 8 + 2] AS fr, s[i * 8 + 3] AS fc, s[i * 8 + 4] AS lfe, s[i * 8 + 5] AS bl, s[i * 8 + 6] AS br, s[i * 8 + 7] AS sl, s[i * 8 + 8] AS sr FROM v, range(0, 8) r(i))"


def _downmix(mode):
    def run(spark, sf_dir):
        left, right = audio.downmix_pair(mode, {n: F.col(n) for n in _CHANNELS})
        return _surround(spark, sf_dir).select("vec_id", "i", F.round(left, 4).alias("l"), F.round(right, 4).alias("r"))

    run.__name__ = f"downmix_{mode}"
    return run


_CLIP = "CASE WHEN abs({0}) <= 0.5 THEN {0} ELSE tanh({0}) END"
for _mode, _l, _r in (
    ("loro", "(fl + 0.7071067811865476 * (fc + sl + bl))", "(fr + 0.7071067811865476 * (fc + sr + br))"),
    ("ltrt", "(fl + 0.7071067811865476 * fc - 0.7071067811865476 * (sl + sr + bl + br))", "(fr + 0.7071067811865476 * fc + 0.7071067811865476 * (sl + sr + bl + br))"),
    ("binaural", "(fl + 0.7071067811865476 * fc + sl - 0.5011872 * br + 0.5011872 * sr)", "(fr + 0.7071067811865476 * fc + sr - 0.5011872 * bl + 0.5011872 * sl)"),
):
    query(f"WITH {_V}, {_SQL_CHANNELS} SELECT vec_id, i, round({_CLIP.format(_l)}, 4) AS l, round({_CLIP.format(_r)}, 4) AS r FROM c")(_downmix(_mode))


@query(f"WITH {_V}, {_SQL_CHANNELS} SELECT vec_id, i, round((fl + fr + fc + lfe + bl + br + sl + sr) / 8, 5) AS mean_all, round((fl + fr + fc + bl + br + sl + sr) / 7, 5) AS mean_mono FROM c")
def downmix_mono(spark, sf_dir):
    """The two mono rules: over all channels, and without the low-frequency one."""
    every = [F.col(n) for n in _CHANNELS]
    return _surround(spark, sf_dir).select("vec_id", "i", F.round(audio.mean_of(every), 5).alias("mean_all"), F.round(audio.mean_of([c for c, n in zip(every, _CHANNELS) if n != "LowFrequency"]), 5).alias("mean_mono"))


@query(f"WITH {_V}, g AS (SELECT vec_id, i::INT AS i, s[8 * i + 1:8 * i + 8] AS s FROM v, range(0, 8) r(i)) SELECT vec_id, i, round(s[1] + s[2] + s[3] + s[5] + s[6], 5) AS kept, round(s[6], 5) AS last, 6::INT AS n FROM g")
def generic_downsize(spark, sf_dir):
    """First of 8 channels to 5 without low frequency; padding repeats the last when 6 of 6 are asked from 5."""
    names = F.array(*map(F.lit, _CHANNELS))
    frames = tables.vectors(spark, sf_dir).select(F.col("frame_no").alias("vec_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"), "samples")
    first = F.slice("samples", F.col("i") * 8 + 1, 8)
    five = audio.fit_channels(first, names, 5)
    six = audio.fit_channels(F.slice(first, 1, 6), F.slice(names, 1, 6), 6)
    return frames.select("vec_id", "i", F.round(F.aggregate(five, F.lit(0.0), lambda a, x: a + x), 5).alias("kept"), F.round(F.element_at(six, -1), 5).alias("last"), F.size(six).alias("n"))


@query("""
SELECT p_partkey, CASE WHEN policy = 'forbid' OR src = dev THEN 'pass' WHEN policy NOT IN ('auto', 'forbid') THEN policy
  WHEN dev = 2 AND surround THEN CASE WHEN hp = 'yes' THEN 'binaural' ELSE 'loro' END ELSE 'average' END AS routing
FROM (SELECT p_partkey, p_size % 8 + 1 AS src, [1, 2, 6][p_partkey % 3 + 1] AS dev, p_partkey % 2 = 0 AS surround, ['yes', 'no', 'unknown'][p_size % 3 + 1] AS hp, ['auto', 'forbid', 'ltrt', 'average', 'auto'][p_partkey % 5 + 1] AS policy FROM part)""")
def route_decision(spark, sf_dir):
    """Every part as a device, a source and a policy: how its channels go."""
    p = tables.table(spark, sf_dir, "part")
    pick = lambda by, *values: F.get(F.array(*map(F.lit, values)), (F.col(by) % len(values)).cast("int"))
    dev, hp, policy = pick("p_partkey", 1, 2, 6), pick("p_size", "yes", "no", "unknown"), pick("p_partkey", "auto", "forbid", "ltrt", "average", "auto")
    return p.select("p_partkey", audio.routing(F.col("p_size") % 8 + 1, dev, F.col("p_partkey") % 2 == 0, hp, policy).alias("routing"))


@query(f"""
WITH {_V}, g AS (SELECT vec_id, s, i, i * (64 / 48.0) AS pos FROM v, range(0, 48) r(i))
SELECT vec_id, round(sum(s[least(floor(pos)::INT, 63) + 1] + (s[least(floor(pos)::INT + 1, 63) + 1] - s[least(floor(pos)::INT, 63) + 1]) * (pos - floor(pos))), 4) AS total, count(*)::INT AS n FROM g GROUP BY 1""")
def resample_linear(spark, sf_dir):
    out = audio.resample_linear(F.col("samples"), 64, 48)
    v = tables.vectors(spark, sf_dir).select(F.col("frame_no").alias("vec_id"), out.alias("o"))
    return v.select("vec_id", F.round(F.aggregate("o", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("o").alias("n"))


@query(f"WITH {_V} SELECT vec_id, round(list_sum(list_transform(s, lambda x: x * power(10, -3 / 20.0))), 4) AS total FROM v")
def volume_gain(spark, sf_dir):
    v = tables.vectors(spark, sf_dir).select(F.col("frame_no").alias("vec_id"), audio.gain(F.col("samples"), -3.0).alias("o"))
    return v.select("vec_id", F.round(F.aggregate("o", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""
SELECT p_partkey, CASE fmt WHEN 'U8' THEN 'pcm_u8' WHEN 'S24' THEN 'pcm_s24le' WHEN 'F64P' THEN 'pcm_f64le' ELSE 'pcm_s16le' END AS codec, CASE lower(trim(mode)) WHEN 'lo/ro' THEN 'loro' WHEN 'mean' THEN 'average' WHEN 'hrtf' THEN 'binaural' END AS mode
FROM (SELECT p_partkey, ['U8', 'S24', 'F64P', 'odd', NULL][(p_partkey % 5)::INT + 1] AS fmt, [' Lo/Ro', 'MEAN ', 'hrtf', 'none'][(p_partkey % 4)::INT + 1] AS mode FROM part)""")
def audio_names(spark, sf_dir):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % n).cast("int"))
    part = tables.table(spark, sf_dir, "part")
    return part.select("p_partkey", audio.pcm_codec(pick(("U8", "S24", "F64P", "odd", None), 5)).alias("codec"), audio.downmix_name(pick((" Lo/Ro", "MEAN ", "hrtf", "none"), 4)).alias("mode"))


@query()
def frame_digest(spark, sf_dir):
    """An ordered fold per stream: beyond SQL, tested against known vectors."""
    p = tables.packets(spark, sf_dir).select("stream_key", "ordinal", "pts", F.col("props").cast("binary").alias("payload"))
    return stream_digests(p, "stream_key", "ordinal")


_FORMATS = ("F32", "F32P", "S16", "S32", "F64", "S24", "U8", "F64P")


@query("""
SELECT p_partkey, f AS cached, CASE WHEN n = 0 OR per >= n * w THEN f ELSE coalesce(CASE WHEN e = 1 THEN 'U8' WHEN e = 2 THEN 'S16' WHEN e = 3 AND p = '' THEN 'S24' WHEN e = 4 AND starts_with(f, 'F') THEN 'F32' WHEN e = 4 THEN 'S32' WHEN e = 8 THEN 'F64' END || p, f) END AS format
FROM (SELECT *, greatest(per // nullif(n, 0), 1) AS e FROM (
  SELECT p_partkey, f, n, w, CASE WHEN f LIKE '%P' THEN 'P' ELSE '' END AS p, CASE WHEN f LIKE '%P' THEN b ELSE b // c END AS per FROM (
    SELECT p_partkey, ['F32', 'F32P', 'S16', 'S32', 'F64', 'S24', 'U8', 'F64P'][(p_partkey % 8)::INT + 1] AS f, [4, 4, 2, 4, 8, 3, 1, 8][(p_partkey % 8)::INT + 1] AS w, p_size::BIGINT * 8 AS b, (p_partkey % 13)::BIGINT AS n, (p_partkey % 2 + 1)::BIGINT AS c FROM part)))""")
def reconcile_formats(spark, sf_dir):
    """Declared sample formats against the bytes that are there."""
    part = tables.table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, _FORMATS)), (F.col("p_partkey") % 8).cast("int")).alias("cached"), (F.col("p_size").cast("long") * 8).alias("b"), (F.col("p_partkey") % 13).alias("n"), (F.col("p_partkey") % 2 + 1).alias("c"))
    return part.select("p_partkey", "cached", audio.reconcile_format(F.col("cached"), F.col("b"), F.col("n"), F.col("c")).alias("format"))


@query("""
SELECT s_suppkey, CASE WHEN t = 'hdmi' THEN 'no' WHEN t = 'builtin' THEN CASE j WHEN 'headphones' THEN 'yes' WHEN 'speaker' THEN 'no' ELSE coalesce(n, 'no') END WHEN t = 'bluetooth' THEN coalesce(n, 'yes') ELSE coalesce(n, 'unknown') END AS verdict
FROM (SELECT s_suppkey, ['hdmi', 'builtin', 'bluetooth', 'usb', NULL][(s_suppkey % 5)::INT + 1] AS t, ['headphones', 'speaker', NULL][(s_suppkey % 3)::INT + 1] AS j, CASE (s_suppkey % 4)::INT WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' END AS n FROM supplier)""")
def headphone_verdicts(spark, sf_dir):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("s_suppkey") % n).cast("int"))
    verdict = audio.headphones(pick(("hdmi", "builtin", "bluetooth", "usb", None), 5), pick(("headphones", "speaker", None), 3), pick(("Sony WH-1000", "Car radio", "My EarBuds", None), 4))
    return tables.table(spark, sf_dir, "supplier").select("s_suppkey", verdict.alias("verdict"))


@query("SELECT event_id, (floor(value)::BIGINT // 2) AS headroom, greatest(4 * 50 - event_id % 300, 0)::BIGINT AS fill, floor(value)::BIGINT // 2 < 50 / 4 OR event_id % 300 >= 240 AS throttled FROM events")
def drain_gate(spark, sf_dir):
    """Room in a two-channel buffer, what is missing to four seconds, and whether to wait."""
    room = audio.headroom(F.floor("value"), F.lit(2))
    queued = F.col("event_id") % 300
    return tables.table(spark, sf_dir, "events").select("event_id", room.alias("headroom"), audio.fill(F.lit(50), queued).alias("fill"), ((room < 50 / 4) | (queued >= 240)).alias("throttled"))
