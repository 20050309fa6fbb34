"""Synthetic audio and pictures from DataFrame expressions: generate://audio/<kind> and generate://image/<kind>."""

from __future__ import annotations

from math import pi
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row and column tones of the telephone keypad, in Hz.
DTMF = {"1": (697, 1209), "2": (697, 1336), "3": (697, 1477), "4": (770, 1209), "5": (770, 1336), "6": (770, 1477), "7": (852, 1209), "8": (852, 1336), "9": (852, 1477), "0": (941, 1336), "*": (941, 1209), "#": (941, 1477)}


def audio_value(kind: str, t: Column, n: Column, p: dict[str, float | str]) -> Column:
    """The sample at time t (seconds), number n."""
    hz = float(p.get("freq", 440))
    turn = 2 * pi * t
    if kind == "sine":
        return F.sin(turn * hz + float(p.get("phase", 0)))
    if kind == "chirp":
        return F.sin(turn * (hz + float(p.get("rise", 400)) * t / 2))
    if kind == "fm":
        return F.sin(turn * hz + float(p.get("index", 2)) * F.sin(turn * float(p.get("mod", 110))))
    if kind == "dtmf":
        low, high = DTMF[str(p.get("key", "5"))]
        return 0.5 * F.sin(turn * low) + 0.5 * F.sin(turn * high)
    if kind == "multitone":
        tones = [float(x) for x in str(p.get("freqs", "220,440,660")).split(",")]
        return sum((F.sin(turn * f) for f in tones), F.lit(0.0)) / len(tones)
    if kind == "ringmod":
        return F.sin(turn * hz) * F.sin(turn * float(p.get("mod", 30)))
    if kind == "tremolo":
        return F.sin(turn * hz) * (1 - float(p.get("depth", 0.5)) * (1 + F.sin(turn * float(p.get("mod", 5)))) / 2)
    if kind == "pwm":
        return F.when(t * hz - F.floor(t * hz) < float(p.get("duty", 0.5)), 1.0).otherwise(-1.0)
    if kind == "supersaw":
        return sum((2 * (t * hz * d - F.floor(t * hz * d + 0.5)) for d in (0.98, 0.99, 1.0, 1.01, 1.02)), F.lit(0.0)) / 5
    if kind == "dc":
        return F.lit(float(p.get("level", 0.5)))
    if kind == "impulse":
        return F.when(n % int(p.get("every", 100)) == 0, 1.0).otherwise(0.0)
    if kind == "noise":  # white, by a hash of the sample number, so partitions do not matter
        return F.pmod(F.xxhash64(n, F.lit(int(p.get("seed", 1)))), F.lit(1 << 24)) / float(1 << 23) - 1
    raise ValueError(f"unknown audio generator {kind}")


def image_value(kind: str, x: Column, y: Column, w: int, h: int, p: dict[str, float | str]) -> Column:
    """The pixel's level from 0 to 1."""
    if kind == "xc":
        return F.lit(float(p.get("level", 0.5)))
    if kind == "gradient":
        return x / float(max(w - 1, 1))
    if kind == "ramp":
        return y / float(max(h - 1, 1))
    if kind == "pattern":
        return ((F.floor(x / 8) + F.floor(y / 8)) % 2).cast("double")
    if kind == "plasma":
        return (F.sin(x / 7.0) + F.sin(y / 5.0) + F.sin((x + y) / 9.0) + 3) / 6
    if kind == "zoneplate":
        return (F.cos((x * x + y * y) * (pi / max(w, h))) + 1) / 2
    if kind == "noise":
        return F.pmod(F.xxhash64(x, y, F.lit(int(p.get("seed", 1)))), F.lit(1 << 24)) / float(1 << 24)
    raise ValueError(f"unknown image generator {kind}")


def audio(spark: SparkSession, kind: str, samples: int, rate: int = 48_000, **p) -> DataFrame:
    """(n, value): one row a sample."""
    rows = spark.range(samples).withColumnRenamed("id", "n")
    return rows.withColumn("value", audio_value(kind, F.col("n") / float(rate), F.col("n"), p))


def image(spark: SparkSession, kind: str, w: int, h: int, frames: int = 1, **p) -> DataFrame:
    """(frame_no, x, y, value): one row a pixel, from one range; movement shifts x by the frame number."""
    rows = spark.range(w * h * frames).select(F.expr(f"id div {w * h}").alias("frame_no"), (F.col("id") % w).alias("x"), F.expr(f"id div {w} % {h}").alias("y"))
    return rows.withColumn("value", image_value(kind, F.pmod(F.col("x") + F.col("frame_no") * int(p.get("speed", 1)), F.lit(w)), F.col("y"), w, h, p))


def open_generator(spark: SparkSession, uri: str) -> DataFrame:
    parts = urlsplit(uri)
    p = {k: v[0] for k, v in parse_qs(parts.query).items()}
    kind = parts.path.strip("/")
    if parts.netloc == "audio":
        return audio(spark, kind, int(p.pop("samples", 48_000)), int(p.pop("rate", 48_000)), **p)
    if parts.netloc in ("image", "video"):
        return image(spark, kind, int(p.pop("w", 64)), int(p.pop("h", 48)), int(p.pop("frames", 1)), **p)
    raise ValueError(f"{uri}: generators are audio, image or video")


def shorthand(text: str) -> str:
    """xc:<level>, gradient: and similar as a generator address; anything else unchanged."""
    kind, _, rest = text.partition(":")
    return f"generate://image/{kind}" + (f"?level={rest}" if kind == "xc" and rest else "") if kind in ("xc", "gradient", "pattern", "plasma", "noise", "ramp") else text
