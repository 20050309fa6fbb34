"""Small still-picture formats: Netpbm, farbfeld, QOI and uncompressed BMP, bytes to arrays and back."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PICTURES = "uri string, width int, height int, channels int, depth int, pixels array<int>"


def read_pnm(data: bytes) -> np.ndarray:
    """P2, P3, P5 and P6 of 8 or 16 bits as height x width x channels."""
    head = re.match(rb"P([2356])\s(?:\s*#[^\n]*\n)*\s*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s", data)
    if not head:
        raise ValueError("not a Netpbm payload")
    kind, w, h, top = (int(head[i]) for i in (1, 2, 3, 4))
    channels = 3 if kind in (3, 6) else 1
    body = data[head.end() :]
    if kind < 5:
        values = np.array(body.split(), np.int64)[: w * h * channels]
    else:
        values = np.frombuffer(body, np.uint8 if top < 256 else ">u2", w * h * channels)
    return values.astype(np.uint8 if top < 256 else np.uint16).reshape(h, w, channels)


def write_pnm(pixels: np.ndarray) -> bytes:
    h, w, channels = pixels.shape
    top = 255 if pixels.dtype == np.uint8 else 65535
    body = pixels.tobytes() if top == 255 else pixels.astype(">u2").tobytes()
    return f"P{6 if channels == 3 else 5}\n{w} {h}\n{top}\n".encode() + body


def read_farbfeld(data: bytes) -> np.ndarray:
    if data[:8] != b"farbfeld":
        raise ValueError("not a farbfeld payload")
    w, h = struct.unpack_from(">II", data, 8)
    return np.frombuffer(data, ">u2", w * h * 4, 16).astype(np.uint16).reshape(h, w, 4)


def write_farbfeld(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    return b"farbfeld" + struct.pack(">II", w, h) + pixels.astype(">u2").tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 24 and 32 bits, rows in either order, as RGB or RGBA."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP payload")
    start, _, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if bits not in (24, 32) or packing not in (0, 3):
        raise ValueError(f"BMP of {bits} bits and packing {packing} is not supported")
    channels, rows = bits // 8, abs(h)
    stride = (w * channels + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : w * channels].reshape(rows, w, channels)
    return (raw[::-1] if h > 0 else raw)[:, :, [2, 1, 0, 3][:channels]]


def write_bmp(pixels: np.ndarray) -> bytes:
    h, w, channels = pixels.shape
    stride = (w * channels + 3) // 4 * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, : w * channels] = pixels[::-1, :, [2, 1, 0, 3][:channels]].reshape(h, -1)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + body.size, 0, 0, 54, 40, w, h, 1, channels * 8, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def _qoi_slot(p: tuple[int, int, int, int]) -> int:
    return (p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64


def read_qoi(data: bytes) -> np.ndarray:
    if data[:4] != b"qoif":
        raise ValueError("not a QOI payload")
    w, h, channels, _ = struct.unpack_from(">IIBB", data, 4)
    out = np.empty((w * h, 4), np.uint8)
    seen, p, at, n = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 14, 0
    while n < w * h:
        b, run = data[at], 1
        at += 1
        if b == 0xFE:
            p, at = (*data[at : at + 3], p[3]), at + 3
        elif b == 0xFF:
            p, at = tuple(data[at : at + 4]), at + 4
        elif b < 0x40:
            p = seen[b]
        elif b < 0x80:
            p = ((p[0] + (b >> 4 & 3) - 2) & 255, (p[1] + (b >> 2 & 3) - 2) & 255, (p[2] + (b & 3) - 2) & 255, p[3])
        elif b < 0xC0:
            green = (b & 63) - 32
            p, at = ((p[0] + green - 8 + (data[at] >> 4)) & 255, (p[1] + green) & 255, (p[2] + green - 8 + (data[at] & 15)) & 255, p[3]), at + 1
        else:
            run = (b & 63) + 1
        seen[_qoi_slot(p)] = p
        out[n : n + run] = p
        n += run
    return out.reshape(h, w, 4)[:, :, :channels]


def write_qoi(pixels: np.ndarray) -> bytes:
    h, w, channels = pixels.shape
    out = bytearray(b"qoif" + struct.pack(">IIBB", w, h, channels, 0))
    seen, last, run = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    for row in pixels.reshape(-1, channels).tolist():
        p = (row[0], row[1], row[2], row[3] if channels == 4 else 255)
        if p == last:
            run += 1
            if run == 62:
                out.append(0xC0 | run - 1)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        slot = _qoi_slot(p)
        signed = [(a - b + 128) % 256 - 128 for a, b in zip(p[:3], last[:3])]
        if seen[slot] == p:
            out.append(slot)
        elif p[3] != last[3]:
            out += bytes([0xFF, *p])
        elif all(-2 <= d <= 1 for d in signed):
            out.append(0x40 | signed[0] + 2 << 4 | signed[1] + 2 << 2 | signed[2] + 2)
        elif -32 <= signed[1] <= 31 and all(-8 <= d - signed[1] <= 7 for d in (signed[0], signed[2])):
            out += bytes([0x80 | signed[1] + 32, signed[0] - signed[1] + 8 << 4 | signed[2] - signed[1] + 8])
        else:
            out += bytes([0xFE, *p[:3]])
        seen[slot] = last = p
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out + b"\0" * 7 + b"\1")


READERS = {"pnm": read_pnm, "farbfeld": read_farbfeld, "bmp": read_bmp, "qoi": read_qoi}
WRITERS = {"pnm": write_pnm, "farbfeld": write_farbfeld, "bmp": write_bmp, "qoi": write_qoi}


def decode(payloads: DataFrame, kind: str) -> DataFrame:
    """(uri, data) to PICTURES rows, pixels in row order with channels interleaved."""
    reader = READERS[kind]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = reader(data)
                row = [[uri], [p.shape[1]], [p.shape[0]], [p.shape[2]], [p.dtype.itemsize * 8], [p.ravel().astype(np.int32)]]
                types = [pa.string(), *[pa.int32()] * 4, pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["uri", "width", "height", "channels", "depth", "pixels"])

    return payloads.select("uri", "data").mapInArrow(read, PICTURES)


def encode(pictures: DataFrame, kind: str) -> DataFrame:
    """PICTURES rows to (uri, data)."""
    writer = WRITERS[kind]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out.append(writer(np.array(r["pixels"], np.uint8 if r["depth"] == 8 else np.uint16).reshape(r["height"], r["width"], r["channels"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["uri", "data"])

    return pictures.select("uri", "width", "height", "channels", "depth", "pixels").mapInArrow(write, "uri string, data binary")
