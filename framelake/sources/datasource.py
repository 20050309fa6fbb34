"""Python data sources: media containers read as packet rows, and WAV written from samples.

The readers take whole payloads through ``binaryFile``, so any store that Spark
reads will do; parsing is one Arrow batch at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PACKET_FIELDS = "uri string, stream_index int, tb_num long, tb_den long, pts long, dts long, duration long, keyframe boolean, data binary"


def wav_header(channels: int, rate: int, bits: int, data_bytes: int, extensible: bool | None = None, mask: int = 0) -> bytes:
    """RIFF header; more than two channels or 16 bits take the extensible form, unless told."""
    extensible = (channels > 2 or bits > 16) if extensible is None else extensible
    align = channels * bits // 8
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else 1, channels, rate, rate * align, align, bits)
    if extensible:
        fmt += struct.pack("<HHI", 22, bits, mask) + struct.pack("<H", 1) + bytes.fromhex("000000001000800000aa00389b71")
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", data_bytes)
    return b"RIFF" + struct.pack("<I", len(body) + data_bytes) + body


def parse_wav(data: bytes) -> tuple[dict, bytes]:
    """(parameters, sample bytes); chunks may come in any order before the data."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV payload")
    at, info, body = 12, {}, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            mask = struct.unpack_from("<I", data, at + 28)[0] if tag == 0xFFFE and size >= 24 else 0
            info = {"tag": tag, "channels": channels, "rate": rate, "bits": bits, "mask": mask}
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if not info:
        raise ValueError("WAV payload without a format")
    return info, body


def wav_packets(data: bytes, frames: int = 1024) -> Iterator[tuple]:
    """(stream, tb_num, tb_den, pts, dts, duration, keyframe, data) in blocks of frames."""
    info, body = parse_wav(data)
    align = info["channels"] * info["bits"] // 8
    for n, at in enumerate(range(0, len(body) // align * align, frames * align)):
        block = body[at : at + frames * align]
        yield 0, 1, info["rate"], n * frames, n * frames, len(block) // align, True, block


def ivf_packets(data: bytes) -> Iterator[tuple]:
    """Frames of an IVF file; the header's rate over scale is the time base."""
    if data[:4] != b"DKIF":
        raise ValueError("not an IVF payload")
    header, den, num = struct.unpack_from("<H", data, 6)[0], *struct.unpack_from("<II", data, 16)
    at, first = header, True
    while at + 12 <= len(data):
        size, pts = struct.unpack_from("<IQ", data, at)
        yield 0, num, den, pts, None, 1, first, data[at + 12 : at + 12 + size]
        at, first = at + 12 + size, False


def ts_packets(data: bytes) -> Iterator[tuple]:
    """PES payloads of an MPEG transport stream: 188-byte packets, random access as keyframe, 33-bit timestamps."""
    open_units: dict[int, list] = {}
    order: list[list] = []
    for at in range(0, len(data) - 187, 188):
        if data[at] != 0x47:
            raise ValueError(f"lost sync at {at}")
        pid, start, adaptation = struct.unpack_from(">H", data, at + 1)[0] & 0x1FFF, data[at + 1] & 0x40, data[at + 3] >> 4 & 3
        body, random_access = at + 4, False
        if adaptation & 2:
            random_access = data[at + 4] > 0 and bool(data[at + 5] & 0x40)
            body += 1 + data[at + 4]
        if not adaptation & 1 or body >= at + 188:
            continue
        payload = data[body : at + 188]
        if start and payload[:3] == b"\0\0\1":
            pts = None
            if payload[7] & 0x80:
                b = payload[9:14]
                pts = (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1
            open_units[pid] = [pid, pts, random_access, [payload[9 + payload[8] :]]]
            order.append(open_units[pid])
        elif pid in open_units and not start:
            open_units[pid][3].append(payload)
    streams = {pid: i for i, pid in enumerate(dict.fromkeys(u[0] for u in order))}
    for pid, pts, key, parts in order:
        yield streams[pid], 1, 90000, pts, None, None, key, b"".join(parts)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most: what a task holds as Python objects does not follow the session's batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Payloads, and packets or frames, that a task holds as Python objects at once.
PAYLOAD_ROWS, PACKET_ROWS = 16, 256
PARSERS = {"wav": wav_packets, "ivf": ivf_packets, "mpegts": ts_packets}


def read_packets(spark: SparkSession, path: str, container: str) -> DataFrame:
    """Packets of every file under path."""
    return demux(spark.read.format("binaryFile").load(path).selectExpr("path AS uri", "content AS data"), container)


def demux(payloads: DataFrame, container: str) -> DataFrame:
    """(uri, data) to packet rows."""
    parser = PARSERS[container]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PACKET_FIELDS.split(", ")]
        types = [pa.string(), pa.int32(), *[pa.int64()] * 5, pa.bool_(), pa.binary()]
        for batch in slices(batches, PAYLOAD_ROWS):
            for uri, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(uri, *row) for row in parser(data)]
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return payloads.select("uri", "data").mapInArrow(parse, PACKET_FIELDS)


def mux_wav(packets: DataFrame, channels: int, rate: int, bits: int = 16) -> DataFrame:
    """(uri, data): one WAV payload per uri from its packets in order; a file is one ordered group."""

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        body = b"".join(rows.sort_by("pts").column("data").to_pylist())
        return pa.table({"uri": pa.array([key[0].as_py()]), "data": pa.array([wav_header(channels, rate, bits, len(body)) + body], pa.binary())})

    return packets.select("uri", "pts", "data").groupBy("uri").applyInArrow(write, "uri string, data binary")


#: Channel mask bits by position.
CHANNEL_BITS = {"FrontLeft": 0x1, "FrontRight": 0x2, "FrontCenter": 0x4, "LowFrequency": 0x8, "BackLeft": 0x10, "BackRight": 0x20, "BackCenter": 0x100, "SideLeft": 0x200, "SideRight": 0x400}


def channel_mask(positions: list[str]) -> int:
    return sum(CHANNEL_BITS[p] for p in positions)


def decode_ulaw(data: bytes) -> np.ndarray:
    """G.711 mu-law bytes as 16-bit samples."""
    u = ~np.frombuffer(data, np.uint8)
    t = ((u & 0x0F).astype(np.int32) << 3) + 0x84 << ((u & 0x70) >> 4)
    return np.where(u & 0x80, 0x84 - t, t - 0x84).astype(np.int16)


def decode_alaw(data: bytes) -> np.ndarray:
    """G.711 A-law bytes as 16-bit samples."""
    a = np.frombuffer(data, np.uint8) ^ np.uint8(0x55)
    exponent, mantissa = ((a & 0x70) >> 4).astype(np.int32), (a & 0x0F).astype(np.int32) << 4
    t = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, t, -t).astype(np.int16)


def encode_ulaw(samples: np.ndarray) -> bytes:
    """16-bit samples as G.711 mu-law bytes."""
    x = samples.astype(np.int32)
    size = np.minimum(np.abs(x), 32635) + 0x84
    exponent = np.floor(np.log2(size)).astype(np.int32) - 7
    mantissa = size >> (exponent + 3) & 0x0F
    return (~(np.where(x < 0, 0x80, 0) | exponent << 4 | mantissa) & 0xFF).astype(np.uint8).tobytes()


def encode_alaw(samples: np.ndarray) -> bytes:
    """16-bit samples as G.711 A-law bytes."""
    x = samples.astype(np.int32)
    size = np.minimum(np.where(x < 0, -x - 1, x), 32767)
    exponent = np.maximum(np.floor(np.log2(np.maximum(size, 1))).astype(np.int32) - 7, 0)
    mantissa = size >> np.where(exponent > 0, exponent + 3, 4) & 0x0F
    return ((np.where(x < 0, 0, 0x80) | exponent << 4 | mantissa) ^ 0x55).astype(np.uint8).tobytes()
