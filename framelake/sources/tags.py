"""Metadata tags of audio payloads: ID3 versions 1 and 2, and Vorbis comments."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Text frames by the usual key.
FRAMES = {"TIT2": "title", "TPE1": "artist", "TPE2": "album_artist", "TALB": "album", "TDRC": "date", "TYER": "date", "TRCK": "track", "TCON": "genre", "COMM": "comment", "TT2": "title", "TP1": "artist", "TAL": "album"}
_ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _text(data: bytes) -> str:
    return data[1:].decode(_ENCODINGS[data[0] & 3], "replace").split("\0")[0] if data else ""


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3v2(data: bytes) -> list[tuple[str, str]]:
    """Text frames in order; none without a tag, and none from a frame that is cut off."""
    if data[:3] != b"ID3" or len(data) < 10:
        return []
    version, end, at, out = data[3], 10 + _synchsafe(data[6:10]), 10, []
    if version >= 3 and data[5] & 0x40:  # an extended header, whose size includes itself from version 4 on
        at += _synchsafe(data[10:14]) if version == 4 else struct.unpack_from(">I", data, 10)[0] + 4
    name_size, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= min(end, len(data)) and data[at]:
        name = data[at : at + name_size].decode("latin-1")
        size = int.from_bytes(data[at + 3 : at + 6], "big") if version == 2 else _synchsafe(data[at + 4 : at + 8]) if version == 4 else struct.unpack_from(">I", data, at + 4)[0]
        body = data[at + head : at + head + size]
        if len(body) < size:
            break
        if name == "COMM" and len(body) > 4:
            wide = body[0] in (1, 2)
            rest = body[4:]
            cut = next((i for i in range(0, len(rest) - wide, 1 + wide) if not any(rest[i : i + 1 + wide])), -1 - wide)
            out.append(("comment", _text(body[:1] + rest[cut + 1 + wide :])))
        elif name in FRAMES:
            out.append((FRAMES[name], _text(body)))
        at += head + size
    return out


def id3v1(data: bytes) -> list[tuple[str, str]]:
    tag = data[-128:]
    if len(tag) < 128 or tag[:3] != b"TAG":
        return []
    fields = [("title", tag[3:33]), ("artist", tag[33:63]), ("album", tag[63:93]), ("date", tag[93:97]), ("comment", tag[97:125] if tag[125] == 0 and tag[126] else tag[97:127])]
    found = [(k, v.split(b"\0")[0].decode("latin-1").strip()) for k, v in fields]
    return [(k, v) for k, v in found if v] + ([("track", str(tag[126]))] if tag[125] == 0 and tag[126] else [])


def vorbis_comments(data: bytes) -> list[tuple[str, str]]:
    """A comment block: vendor, then KEY=value pairs with keys in lower case."""
    size = struct.unpack_from("<I", data, 0)[0]
    at, out = 4 + size, []
    count = struct.unpack_from("<I", data, at)[0]
    at += 4
    for _ in range(count):
        size = struct.unpack_from("<I", data, at)[0]
        k, _, v = data[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        out.append((k.lower(), v))
        at += 4 + size
    return out


def tags(payloads: DataFrame) -> DataFrame:
    """(uri, ord, k, v) of payloads (uri, data): version 2 tags, else version 1."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(uri, i, k, v) for uri, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, (k, v) in enumerate(id3v2(data or b"") or id3v1(data or b""))]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["uri", "ord", "k", "v"])

    return payloads.select("uri", "data").mapInArrow(read, "uri string, ord int, k string, v string")
