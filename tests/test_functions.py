"""Scalar functions, metrics and digests against known values."""

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import audio, digest, mesh, pixel, text, timebase


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_digest_vectors():
    assert digest.fnv1a([b""]) == 0xCBF29CE484222325
    assert digest.fnv1a([b"a"]) == 0xAF63DC4C8601EC8C
    assert list(digest.audio_frame_parts(None, 1, [b"x"])) == list(digest.audio_frame_parts(0, 1, [b"x"]))


def test_stream_digest_does_not_depend_on_partitions(spark):
    rows = [("a", i, i * 40, bytes([i % 251])) for i in range(50)] + [("b", i, None, b"") for i in range(5)]
    frame = spark.createDataFrame(rows, "s string, n long, pts long, payload binary")
    one_way, other = (sorted(map(tuple, digest.stream_digests(frame.repartition(n), "s", "n").collect())) for n in (1, 7))
    assert one_way == other and one_way[0][1] == 50


def test_decode_samples():
    assert audio.decode_samples(bytes([0, 128, 255]), "U8").tolist() == [-1.0, 0.0, 127 / 128]
    assert audio.decode_samples(np.array([-32768, 16384], "<i2").tobytes(), "S16").tolist() == [-1.0, 0.5]
    assert audio.decode_samples(b"\x00\x00\x80\xff\xff\x7f\x01", "S24").tolist() == pytest.approx([-1.0, 8388607 / 8388608])
    assert audio.decode_samples(np.array([0.25], "<f8").tobytes(), "F64P").tolist() == [0.25]
    assert len(audio.decode_samples(b"abc", "ADPCM")) == 0


def test_samples_of(spark):
    frame = spark.createDataFrame([(np.array([0, 16384], "<i2").tobytes(), "S16"), (None, "S16"), (b"\x80", "U8")], "d binary, k string")
    assert [r[0] for r in frame.select(audio.samples_of(F.col("d"), F.col("k"))).collect()] == [[0.0, 0.5], None, [0.0]]


def test_soft_clip_steps_down_above_a_half(spark):
    assert one(spark, audio.soft_clip(F.lit(0.5)), audio.soft_clip(F.lit(0.5001))) == pytest.approx((0.5, math.tanh(0.5001)))


def test_resample(spark):
    ramp = F.array(*(F.lit(float(i)) for i in range(8)))
    assert one(spark, audio.resample_linear(ramp, 2, 1))[0] == [0.0, 2.0, 4.0, 6.0]
    assert one(spark, audio.resample_linear(ramp, 1, 2))[0][-3:] == [6.5, 7.0, 7.0]
    assert one(spark, audio.resample_linear(F.array().cast("array<double>"), 1, 2))[0] == []


def test_interleave(spark):
    planes = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))
    assert one(spark, audio.interleave(planes, F.lit(2)))[0] == [1, 3, 2, 4]


def test_clocks(spark):
    got = one(spark, timebase.clock_hours(F.lit(59_999_000)), timebase.clock_minutes(F.lit(3_725_250_000)), timebase.overlay_clock(F.lit(3725.9)), timebase.overlay_clock(F.lit(65.0)))
    assert got == ("00:00:60.00", "62:05.25", "1:02:05", "1:05")


def test_clocks_round_as_printf_does(spark):
    """Every half of a hundredth in a minute, and their neighbours: 1.005 is a little less than it reads."""
    at = spark.range(6000).selectExpr("explode(array(id * 10000 + 4999, id * 10000 + 5000, id * 10000 + 5001)) AS us")
    got = at.select("us", timebase.clock_hours(F.col("us")).alias("h"), timebase.clock_minutes(F.col("us") + 3_600_000_000).alias("m")).collect()
    assert [(r.h, r.m) for r in got] == [(f"00:00:{r.us / 1e6:05.2f}", f"60:{r.us / 1e6:05.2f}") for r in got]


def test_rescale(spark):
    x = lambda v, r="nearest": timebase.rescale(F.lit(v), 1, 1000, 1, 90_000, r)
    y = lambda v, r: timebase.rescale(F.lit(v), 1, 90_000, 1, 1000, r)
    assert one(spark, x(7), y(45, "nearest"), y(-45, "nearest"), y(-1, "down"), y(-1, "zero"), y(134, "nearest")) == (630, 1, -1, -1, 0, 1)
    assert one(spark, timebase.rescale(F.lit(2**62).cast("long"), 1, 1_000_000, 1, 1_000_000)) == (2**62,)


def test_clock_position(spark):
    p = lambda raw: timebase.clock_position(F.lit(10.0), F.lit(raw), F.lit(48000.0), F.lit(48000.0))
    assert one(spark, p(6.0), p(0.5)) == (15.0, 10.0)


def test_addresses(spark):
    ext = lambda u: text.extension(F.lit(u))
    assert one(spark, ext("a/b.MP4?q=1.x"), ext("a/b"), ext("x.y/z"), text.stem(F.lit("a/b.tar.gz?x")), text.stem(F.lit("a/.b"))) == ("mp4", None, None, "b.tar", None)


def test_sizes(spark):
    h = lambda n: text.human_bytes(F.lit(n))
    assert one(spark, h(1023), h(1024), h(1 << 20), text.iec_bytes(F.lit(1536)), text.iec_bytes(F.lit(1 << 40))) == ("1023 B", "1 KB", "1.0 MB", "1.5 KiB", "1.0 TiB")


def test_pixels(spark):
    r, g, b = pixel.yuv_to_rgb_709(F.lit(0.5), F.lit(0.5), F.lit(0.5))
    assert one(spark, r, g, b) == (0.5, 0.5, 0.5)
    assert one(spark, *pixel.rgb_to_yuv(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == pytest.approx((1.0, 0.5, 0.5))
    assert one(spark, pixel.pixel_format(F.lit("YUV420P")), pixel.pixel_format(F.lit("nope"))) == ("yuv420p", None)
    assert tuple(one(spark, pixel.fit_rect(F.lit(16), F.lit(9), F.lit(640), F.lit(480)))[0]) == (0, 60, 640, 360)
    assert tuple(one(spark, pixel.fit_rect(F.lit(0), F.lit(9), F.lit(64), F.lit(48)))[0]) == (0, 0, 64, 48)
    assert tuple(one(spark, pixel.over(F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(1.0)))[0]) == (0.5, 1.0)
    assert one(spark, pixel.pq_to_linear(F.lit(1.0)), pixel.pq_to_linear(F.lit(0.0))) == pytest.approx((1.0, 0.0), abs=1e-6)


def test_bayer_ranks_are_a_permutation(spark):
    grid = spark.range(64).select(pixel.bayer_rank((F.col("id") % 8).cast("int"), F.floor(F.col("id") / 8).cast("int")).alias("r"))
    assert sorted(r.r for r in grid.collect()) == list(range(64))


def test_mesh(spark):
    got = one(spark, mesh.canonical_extents(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit("Y"), F.lit(0.01)), mesh.approx_eq(F.lit(100.0), F.lit(100.9)), mesh.approx_eq(F.lit(1.0), F.lit(1.2)))
    assert tuple(got[0]) == pytest.approx((0.01, 0.03, 0.02)) and got[1:] == (True, False)
    moved = mesh.morph(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.array(F.lit(2.0), F.lit(0.0))), F.array(F.lit(0.25)))
    assert one(spark, moved)[0] == [1.5, 1.0]


def test_reconcile_format(spark):
    rows = [("F32", 400, 100, 1, "F32"), ("F32", 200, 100, 1, "S16"), ("F32P", 200, 100, 2, "S16P"), ("S16", 100, 100, 1, "U8"), ("F64", 400, 100, 1, "F32"), ("S32", 300, 100, 1, "S24"), ("F64P", 300, 100, 1, "F64P"), ("F32", 0, 100, 1, "F32"), ("F32", 100, 0, 1, "F32")]
    frame = spark.createDataFrame(rows, "c string, b int, n int, ch int, want string")
    for r in frame.withColumn("got", audio.reconcile_format(F.col("c"), F.col("b"), F.col("n"), F.col("ch"))).collect():
        assert r.got == r.want, r


def test_headphones(spark):
    rows = [("hdmi", None, "AirPods", "no"), ("builtin", "headphones", None, "yes"), ("builtin", "speaker", "buds", "no"), ("builtin", None, None, "no"), ("bluetooth", None, None, "yes"), ("bluetooth", None, "Car", "no"), ("usb", None, "Jabra 75", "yes"), ("usb", None, None, "unknown"), (None, None, None, "unknown")]
    frame = spark.createDataFrame(rows, "t string, j string, n string, want string")
    for r in frame.withColumn("got", audio.headphones(F.col("t"), F.col("j"), F.col("n"))).collect():
        assert r.got == r.want, r
    assert one(spark, audio.headroom(F.lit(7), F.lit(2)), audio.fill(F.lit(10), F.lit(50))) == (3, 0)


def test_planes(spark):
    tight = lambda data, stride, w, h: bytes(one(spark, pixel.plane_tight(F.lit(data), F.lit(stride), F.lit(w), F.lit(h)))[0])
    assert tight(b"ab..cd..", 4, 2, 2) == b"abcd" and tight(b"ab..c", 4, 2, 2) == b"ab" and tight(b"abcd", 2, 2, 2) == b"abcd" and tight(b"", 4, 2, 2) == b""
    planes = one(spark, pixel.planes_or_gray(F.lit(None).cast("array<binary>"), F.lit(4), F.lit(2)))[0]
    assert [bytes(p) for p in planes] == [b"\x80" * 8, b"\x80" * 2, b"\x80" * 2]
    assert tuple(one(spark, pixel.letterbox_uniform(F.lit(200.0), F.lit(100.0), F.lit(100.0), F.lit(100.0)))[0]) == (1.0, 2.0, 0.0, 0.25)


def test_scene_values(spark):
    props = F.array(F.struct(F.lit("UnitScaleFactor").alias("name"), F.lit("2.54").alias("value")))
    assert one(spark, mesh.fbx_metres(props), mesh.fbx_metres(F.slice(props, 1, 0)), mesh.morph_weights(F.lit(None).cast("double"), F.lit(0.25))) == pytest.approx((0.0254, 0.01, 0.25))


def test_fractions_round_half_up_exactly(spark):
    from framelake.functions import pixel, timebase

    cases = [(1, 8, 2), (5, 1000, 2), (225, 1000_00, 5), (9, 40_000, 5), (0, 7, 3), (2, 3, 4)]
    for num, den, digits in cases:
        want = float((Decimal(num) / Decimal(den)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
        assert one(spark, timebase.rounded_fraction(F.lit(num), F.lit(den), digits))[0] == want
    found = one(spark, pixel.letterbox_fractions(F.lit(160), F.lit(900), F.lit(1920), F.lit(1080)))[0]
    assert tuple(found.ox) == (1728000 - 172800, 2 * 1728000) and tuple(found.sy) == (1, 1)
