"""The codec registry: what this engine decodes and encodes itself, and what it only knows by name.

Rows of the registry resolve like any other table (operators/registry.py): the
backend of the lowest priority wins, hardware can be required or avoided.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.audio import decode_samples
from . import adpcm, datasource, images

IMPLS = "codec string, backend string, media_type string, priority int, seq int, decode boolean, encode boolean, hardware boolean, lossless boolean, accepted array<string>"

#: Public codecs that are known by name only; their entropy coding is no query.
NAMED = {
    "Audio": ("flac", "vorbis", "opus", "mp1", "mp2", "mp3", "aac", "celt", "speex", "gsm", "g722", "g723_1", "g726", "g728", "g729", "adpcm_ms", "ilbc", "ac3", "ac4", "midi", "shorten", "tta", "musepack", "cook", "wma", "wavpack", "ape", "dts", "aptx"),
    "Video": ("mjpeg", "ffv1", "mpeg1", "mpeg2", "mpeg4", "theora", "h261", "h263", "h264", "h265", "h266", "vp6", "vp8", "vp9", "av1", "dirac", "prores", "evc", "huffyuv", "lagarith", "utvideo", "magicyuv", "cinepak", "svq1", "svq3", "indeo3", "indeo5"),
    "Image": ("png", "gif", "webp", "jpeg", "tiff", "ico", "jpeg2000", "jpegxl", "jpegxs", "avif", "dds", "openexr", "hdr", "tga", "wbmp", "pcx", "ilbm"),
}


@dataclass
class Codec:
    codec: str
    media_type: str
    decode: Callable[[bytes], np.ndarray] | None = None
    encode: Callable[[np.ndarray], bytes] | None = None
    backend: str = "builtin"
    priority: int = 100
    hardware: bool = False
    lossless: bool = True
    accepted: tuple[str, ...] = ()
    #: Decodes a batch of payloads at once, where that is faster than one by one.
    decode_many: Callable[[list[bytes]], list[np.ndarray]] | None = None


@dataclass
class Registry:
    """Many implementations per codec, in order of registration."""

    impls: list[Codec] = field(default_factory=list)

    def register(self, impl: Codec) -> Registry:
        self.impls.append(impl)
        return self

    def rows(self, spark: SparkSession) -> DataFrame:
        out = [(c.codec, c.backend, c.media_type, c.priority, i, c.decode is not None, c.encode is not None, c.hardware, c.lossless, list(c.accepted)) for i, c in enumerate(self.impls)]
        return spark.createDataFrame(out, IMPLS)

    def resolve(self, codec: str, side: str, no_hardware: bool = False, require_hardware: bool = False, usable: Callable[[Codec], bool] = lambda c: True) -> Codec:
        """The first usable implementation by priority; avoiding hardware only puts it last."""
        able = [(c.priority + 10_000 * (no_hardware and c.hardware), i, c) for i, c in enumerate(self.impls) if c.codec == codec and getattr(c, side) is not None and (c.hardware or not require_hardware)]
        for _, _, c in sorted(able, key=lambda x: x[:2]):
            if usable(c):
                return c
        raise LookupError(f"no {'hardware ' if require_hardware else ''}implementation can {side} {codec}")


def _pcm(kind: str) -> Callable[[bytes], np.ndarray]:
    return lambda data: decode_samples(data, kind)


def _integers(kind: str, scale: float) -> Callable[[np.ndarray], bytes]:
    top = np.iinfo(kind).max
    return lambda x: np.clip(np.round(np.asarray(x, float) * scale), -top - 1, top).astype(kind).tobytes()


def _s24(x: np.ndarray) -> bytes:
    wide = np.clip(np.round(np.asarray(x, float) * 8388608), -8388608, 8388607).astype("<i4")
    return wide.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def register_all(registry: Registry | None = None) -> Registry:
    """Everything that is built in, then the names."""
    r = registry or Registry()
    r.register(Codec("pcm_u8", "Audio", _pcm("U8"), lambda x: np.clip(np.round(np.asarray(x, float) * 128 + 128), 0, 255).astype(np.uint8).tobytes()))
    r.register(Codec("pcm_s8", "Audio", _pcm("S8"), _integers("i1", 128)))
    r.register(Codec("pcm_s16le", "Audio", _pcm("S16"), _integers("<i2", 32768)))
    r.register(Codec("slin", "Audio", _pcm("S16"), _integers("<i2", 32768)))
    r.register(Codec("pcm_s24le", "Audio", _pcm("S24"), _s24))
    r.register(Codec("pcm_s32le", "Audio", _pcm("S32"), _integers("<i4", 2147483648)))
    r.register(Codec("pcm_f32le", "Audio", _pcm("F32"), lambda x: np.asarray(x, "<f4").tobytes()))
    r.register(Codec("pcm_f64le", "Audio", _pcm("F64"), lambda x: np.asarray(x, "<f8").tobytes()))
    whole = lambda x: np.clip(np.round(np.asarray(x, float) * 32768), -32768, 32767)
    r.register(Codec("pcm_mulaw", "Audio", lambda d: datasource.decode_ulaw(d).astype(np.float32) / 32768, lambda x: datasource.encode_ulaw(whole(x)), lossless=False))
    r.register(Codec("pcm_alaw", "Audio", lambda d: datasource.decode_alaw(d).astype(np.float32) / 32768, lambda x: datasource.encode_alaw(whole(x)), lossless=False))
    ima = lambda blocks: [s.astype(np.float32) / 32768 for s in adpcm.decode_ima(blocks)]
    r.register(Codec("adpcm_ima_wav", "Audio", lambda d: ima([d])[0], lambda x: adpcm.encode_ima([whole(x).astype(np.int64)])[0], lossless=False, decode_many=ima))
    r.register(Codec("8svx_fib", "Audio", lambda d: adpcm.decode_delta8(d).astype(np.float32) / 128, lossless=False))
    for kind in images.READERS:
        r.register(Codec(kind, "Image", images.READERS[kind], images.WRITERS[kind], accepted=("rgb24", "rgba")))
    for media, names in NAMED.items():
        for name in names:
            r.register(Codec(name, media, priority=1000, lossless=False))
    return r


def decode_packets(packets: DataFrame, registry: Registry, codec: str) -> DataFrame:
    """packets (uri, stream_index, pts, data) with samples array<float> in place of data; no packet needs another one."""
    found = registry.resolve(codec, "decode")
    many = found.decode_many or (lambda blocks: list(map(found.decode, blocks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in datasource.slices(batches, datasource.PACKET_ROWS):
            data = batch.column(3).to_pylist()
            decoded = iter(many([d for d in data if d is not None]))
            samples = [None if d is None else next(decoded).astype(np.float32) for d in data]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(samples, pa.list_(pa.float32()))], names=["uri", "stream_index", "pts", "samples"])

    return packets.select("uri", "stream_index", "pts", "data").mapInArrow(run, "uri string, stream_index int, pts long, samples array<float>")


def encode_packets(frames: DataFrame, registry: Registry, codec: str) -> DataFrame:
    """The way back: samples to data."""
    encode = registry.resolve(codec, "encode").encode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in datasource.slices(batches, datasource.PACKET_ROWS):
            data = [None if s is None else encode(np.array(s, np.float64)) for s in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], names=["uri", "stream_index", "pts", "data"])

    return frames.select("uri", "stream_index", "pts", "samples").mapInArrow(run, "uri string, stream_index int, pts long, data binary")


def listing(impls: DataFrame) -> DataFrame:
    """(media_type, codec, decode, encode, backends): one row a codec, sections in the usual order first."""
    rank = F.when(F.col("media_type") == "Video", 0).when(F.col("media_type") == "Audio", 1).when(F.col("media_type") == "Subtitle", 2).when(F.col("media_type") == "Data", 3).otherwise(4)
    ordered = F.array_sort(F.collect_list(F.struct("priority", "seq", "backend")))
    rows = impls.groupBy("media_type", "codec").agg(F.bool_or("decode").alias("decode"), F.bool_or("encode").alias("encode"), F.array_join(F.transform(ordered, lambda x: x["backend"]), ",").alias("backends"))
    return rows.orderBy(rank, "media_type", "codec")
