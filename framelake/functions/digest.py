"""Ordered 64-bit FNV-1a digests of frames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1
#: Fixed values of the public hash.
OFFSET_BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(parts: Iterable[bytes], state: int = OFFSET_BASIS) -> int:
    for part in parts:
        for byte in part:
            state = ((state ^ byte) * PRIME) & _MASK
    return state


def audio_frame_parts(pts: int | None, samples: int, planes: list[bytes]) -> Iterator[bytes]:
    """Timestamp (null as 0), samples, number of planes, then length and bytes of each."""
    yield (pts or 0).to_bytes(8, "little", signed=True)
    yield samples.to_bytes(8, "little")
    yield len(planes).to_bytes(8, "little")
    for plane in planes:
        yield len(plane).to_bytes(8, "little")
        yield bytes(plane)


def stream_digests(frames: DataFrame, stream: str, order: str) -> DataFrame:
    """One digest per stream over rows (stream, order, pts, payload binary) in order.

    Each byte changes what the next one does, so a stream is one task, but it is
    sorted by Spark (which spills) and read in batches; only the state is kept.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([count], pa.int64()), pa.array([f"{state:016x}"])], names=[stream, "frames", "digest"])

        key, count, state = None, 0, OFFSET_BASIS
        for batch in batches:
            for name, pts, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if count and name != key:
                    yield done()
                    count, state = 0, OFFSET_BASIS
                key, count = name, count + 1
                state = fnv1a(audio_frame_parts(pts, 1, [payload or b""]), state)
        if count:
            yield done()

    ordered = frames.repartition(stream).sortWithinPartitions(stream, order)
    return ordered.select(F.col(stream).cast("string"), "pts", "payload").mapInArrow(fold, f"{stream} string, frames long, digest string")


def verified(payload: Column, crc32: Column | None = None, md5: Column | None = None) -> Column:
    """Whether a payload has the declared checksums; null where none is declared."""
    checks = []
    if crc32 is not None:
        checks.append(F.crc32(payload.cast("binary")) == crc32)
    if md5 is not None:
        checks.append(F.md5(payload.cast("binary")) == F.lower(md5))
    none = F.lit(None).cast("boolean")
    given = F.coalesce(*checks, none)
    return F.when(given.isNotNull(), F.least(*(F.coalesce(c, F.lit(True)) for c in checks), F.lit(True))).otherwise(none)
