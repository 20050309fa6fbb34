"""Sample formats, routing, downmix, resampling and gain on arrays of samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed gains of the two-channel downmixes.
CENTRE, BACK = 0.7071067811865476, 0.5011872

#: The PCM codec of each sample format.
PCM_CODECS = {"U8": "pcm_u8", "S16": "pcm_s16le", "S24": "pcm_s24le", "S32": "pcm_s32le", "F32": "pcm_f32le", "F64": "pcm_f64le"}
BYTES_PER_SAMPLE = {"U8": 1, "S8": 1, "S16": 2, "S24": 3, "S32": 4, "F32": 4, "F64": 8}


def pcm_codec(sample_format: Column) -> Column:
    """The PCM codec that keeps a sample format; 16 bits for a null or another one."""
    table = F.create_map(*[F.lit(x) for pair in PCM_CODECS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.regexp_replace(F.coalesce(sample_format, F.lit("S16")), "P$", "")), F.lit("pcm_s16le"))


def decode_samples(data: np.ndarray | bytes, sample_format: str) -> np.ndarray:
    """Little-endian samples as floats of nominal range -1 to 1; an unknown format gives none."""
    raw = np.frombuffer(data, np.uint8)
    kind = sample_format.removesuffix("P")
    width = BYTES_PER_SAMPLE.get(kind)
    if width is None:
        return np.zeros(0, np.float32)
    raw = raw[: len(raw) // width * width]
    if kind == "U8":
        return (raw.astype(np.float32) - 128) / 128
    if kind == "S24":
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = raw.reshape(-1, 3)
        return (wide.view("<i4").ravel() >> 8).astype(np.float32) / np.float32(8388608)
    scale = {"S8": 128, "S16": 32768, "S32": 2147483648}.get(kind, 1)
    values = raw.view({"S8": "i1", "S16": "<i2", "S32": "<i4", "F32": "<f4", "F64": "<f8"}[kind])
    return (values.astype(np.float64) / scale).astype(np.float32)


def encode_s16(samples: np.ndarray) -> bytes:
    return np.clip(np.trunc(samples * 32767.0), -32768, 32767).astype("<i2").tobytes()


def samples_of(data: Column, sample_format: Column) -> Column:
    """Arrow UDF: payload bytes to array<float>."""

    @F.pandas_udf("array<float>")
    def decode(payload: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else decode_samples(bytes(b), k or "S16") for b, k in zip(payload, kind)])

    return decode(data, sample_format)


def soft_clip(s: Column) -> Column:
    """Unchanged up to 0.5 in size, tanh beyond."""
    return F.when(F.abs(s) <= 0.5, s).otherwise(F.tanh(s))


def downmix_pair(mode: str, c: dict[str, Column]) -> tuple[Column, Column]:
    """Left and right of loro, ltrt, binaural or average; c: channels by position, missing ones 0."""
    g = lambda name: c.get(name, F.lit(0.0))
    k, b = F.lit(CENTRE), F.lit(BACK)
    if mode == "ltrt":
        surround = g("SideLeft") + g("SideRight") + g("BackLeft") + g("BackRight")
        left, right = g("FrontLeft") + k * g("FrontCenter") - k * surround, g("FrontRight") + k * g("FrontCenter") + k * surround
    elif mode == "binaural":
        left = g("FrontLeft") + k * g("FrontCenter") + g("SideLeft") - b * g("BackRight") + b * g("SideRight") + k * g("BackCenter")
        right = g("FrontRight") + k * g("FrontCenter") + g("SideRight") - b * g("BackLeft") + b * g("SideLeft") + k * g("BackCenter")
    else:  # an average to two channels takes the loro matrix
        left = g("FrontLeft") + k * (g("FrontCenter") + g("SideLeft") + g("BackLeft") + g("BackCenter"))
        right = g("FrontRight") + k * (g("FrontCenter") + g("SideRight") + g("BackRight") + g("BackCenter"))
    return soft_clip(left), soft_clip(right)


def mean_of(channels: list[Column]) -> Column:
    return sum(channels[1:], channels[0]) / len(channels)


def fit_channels(samples: Column, positions: Column, wanted: int) -> Column:
    """Without the low-frequency channel, the first ``wanted``, padded with the last."""
    kept = F.filter(F.arrays_zip(samples.alias("s"), positions.alias("p")), lambda x: x["p"] != "LowFrequency")
    values = F.transform(kept, lambda x: x["s"])
    pad = F.greatest(F.lit(0), F.lit(wanted) - F.size(values))
    return F.concat(F.slice(values, 1, wanted), F.array_repeat(F.element_at(values, -1), pad))


def routing(source_channels: Column, device_channels: Column, surround: Column, headphones: Column, policy: Column) -> Column:
    """pass, loro, binaural or average; policy: auto, forbid or the name of a forced mode."""
    forced = ~policy.isin("auto", "forbid")
    equal = source_channels == device_channels
    return (
        F.when((policy == "forbid") | equal, "pass")
        .when(forced, policy)
        .when((device_channels == 2) & surround, F.when(headphones == "yes", "binaural").otherwise("loro"))
        .otherwise("average")
    )


def downmix_name(text: Column) -> Column:
    """The mode that a synonym names, or null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("loro", "lo/ro"), "loro").when(t.isin("ltrt", "lt/rt"), "ltrt").when(t.isin("binaural", "hrtf"), "binaural").when(t.isin("average", "avg", "mean"), "average")


def resample_linear(samples: Column, source_rate: int, target_rate: int) -> Column:
    """floor(n * target / source) samples, linear between neighbours; each frame by itself."""
    n = F.size(samples)
    wanted = F.floor(n * target_rate / source_rate).cast("int")

    def at(i: Column) -> Column:
        position = i * (source_rate / target_rate)
        index = F.floor(position).cast("int")
        a = F.get(samples, F.least(index, n - 1))
        b = F.get(samples, F.least(index + 1, n - 1))
        return a + (b - a) * (position - index)

    return F.when(wanted > 0, F.transform(F.sequence(F.lit(0), wanted - 1), at)).otherwise(F.slice(samples, 1, 0))


def gain(samples: Column, db: float) -> Column:
    return F.transform(samples, lambda x: x * float(10 ** (db / 20)))


def interleave(planes: Column, n: Column) -> Column:
    """planes array<array>: sample by sample, plane by plane."""
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(planes, lambda p: F.get(p, i))))


def tone(n: int, rate: int) -> np.ndarray:
    """Reference signal: a 440 Hz sine and a rising chirp, clipped to 16 bits."""
    t = np.arange(n) / rate
    chirp = np.sin(2 * np.pi * (800 + 400 * t / (n / rate)) * t)
    x = 0.5 * np.sin(2 * np.pi * 440 * t) + 0.3 * chirp
    x[rate : rate + 5] += 0.8
    return np.trunc(np.clip(x, -1, 1) * 30000).astype(np.int16)


def reconcile_format(cached: Column, plane_bytes: Column, samples: Column, channels: Column) -> Column:
    """The cached sample format if the first plane is long enough for it, else the one that its size fits.

    Planar stays planar and float stays float; a size that no format has keeps the cached one.
    """
    planar, floating = cached.endswith("P"), cached.startswith("F")
    width = F.substring(F.regexp_extract(cached, "([0-9]+)", 1), 1, 2).cast("int") / 8
    per_plane = F.when(planar, plane_bytes).otherwise(F.floor(plane_bytes / F.greatest(channels, F.lit(1))))
    each = F.greatest(F.floor(per_plane / F.when(samples > 0, samples)), F.lit(1))
    base = F.when(each == 1, "U8").when(each == 2, "S16").when((each == 3) & ~planar, "S24").when((each == 4) & floating, "F32").when(each == 4, "S32").when(each == 8, "F64")
    fitted = F.coalesce(F.concat(base, F.when(planar, "P").otherwise("")), cached)
    return F.when((samples == 0) | F.coalesce(plane_bytes == 0, F.lit(True)) | (per_plane >= samples * width), cached).otherwise(fitted)


#: Parts of device names that tell headphones.
HEADPHONE_HINTS = ("airpods", "airpod", "beats", "powerbeats", "bose", "sony wh-", "sony wf-", "sennheiser", "jabra", "jbl", "skullcandy", "soundcore", "anker", "headphone", "headset", "earphone", "earbud", "buds")


def headphones(transport: Column, jack: Column, name: Column) -> Column:
    """yes, no or unknown from how a device is attached (its transport and jack) and what it is called."""
    low = F.lower(name)
    hint = F.exists(F.array(*map(F.lit, HEADPHONE_HINTS)), lambda h: F.contains(low, h))
    by_name = F.when(name.isNotNull(), F.when(hint, "yes").otherwise("no"))
    built_in = F.when(jack == "headphones", "yes").when(jack == "speaker", "no").otherwise(F.coalesce(by_name, F.lit("no")))
    return (
        F.when(transport.isin("hdmi", "displayport", "airplay", "avb", "thunderbolt"), "no")
        .when(transport == "builtin", built_in)
        .when(transport.isin("bluetooth", "bluetooth-le"), F.coalesce(by_name, F.lit("yes")))
        .otherwise(F.coalesce(by_name, F.lit("unknown")))
    )


def headroom(vacant: Column, channels: Column) -> Column:
    """Whole frames that still fit."""
    return F.floor(vacant / F.greatest(channels, F.lit(1))).cast("long")


def fill(rate: Column, queued: Column) -> Column:
    """Samples missing to a buffer of four seconds."""
    return F.greatest(4 * rate - queued, F.lit(0)).cast("long")
