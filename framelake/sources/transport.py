"""MPEG transport streams written from packets: 188-byte cells as rows, made by column expressions.

A packet is cut into cells where it stands; the continuity counter of a stream is a
running sum in blocks, so no stream has to pass through one task.  Only the two
tables at a file's head, one row a file, take a Python helper.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import blocked

#: Cell and payload bytes, first stream's PID, the program map's PID, the stream type written for every stream.
CELL, ROOM, FIRST_PID, MAP_PID, PRIVATE = 188, 184, 0x100, 0x1000, 0x06


def _bytes(value: Column, digits: int) -> Column:
    """A number as so many hex digits of binary."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), digits, "0"))


def _stamp(pts: Column) -> Column:
    """The five bytes of a 33-bit timestamp with its marker bits."""
    p = F.pmod(pts, F.lit(1 << 33))
    bits = lambda shift, n: F.shiftright(p, shift).bitwiseAND((1 << n) - 1)
    return _bytes((F.lit(0x21) + bits(30, 3) * 2) * (1 << 32) + bits(22, 8) * (1 << 24) + (bits(15, 7) * 2 + 1) * (1 << 16) + bits(7, 8) * (1 << 8) + bits(0, 7) * 2 + 1, 10)


def _crc(section: bytes) -> bytes:
    """The tables' checksum: the usual polynomial with its bits in the other order."""
    turned = bytes(int(f"{b:08b}"[::-1], 2) for b in section)
    return (int(f"{zlib.crc32(turned):032b}"[::-1], 2) ^ 0xFFFFFFFF).to_bytes(4, "big")


def _table(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    """One cell with a section: program association or program map."""
    section = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    cell = b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + section + _crc(section)
    if len(cell) > CELL:
        raise ValueError("more streams than one program map cell holds")
    return cell.ljust(CELL, b"\xff")


def head_tables(streams: list[int]) -> list[bytes]:
    """Association and map of one program with these streams; the first one carries the clock."""
    listed = b"".join(bytes([PRIVATE]) + (0xE000 | FIRST_PID + s).to_bytes(2, "big") + b"\xf0\0" for s in streams)
    return [_table(0, 0, 1, (1).to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big")), _table(MAP_PID, 2, 1, (0xE000 | FIRST_PID + streams[0]).to_bytes(2, "big") + b"\xf0\0" + listed)]


def ts_cells(packets: DataFrame) -> DataFrame:
    """(uri, at, cell, data): the cells of packets (uri, at long, stream_index, pts, keyframe, data), in the order of (at, cell).

    ``at`` orders a file's packets and is not negative; the tables stand at -1.  A
    keyframe sets the random access indicator of its first cell; a null pts writes no
    timestamp; null data is empty.
    """
    body = F.coalesce("data", F.lit(b""))
    head = F.when(F.col("pts").isNull(), F.unhex(F.lit("000001E00000800000"))).otherwise(F.concat(F.unhex(F.lit("000001E00000808005")), _stamp(F.col("pts"))))
    units = packets.select("uri", "at", "stream_index", F.coalesce("keyframe", F.lit(False)).alias("key"), F.concat(head, body).alias("unit"))
    units = units.withColumns({"lead": F.when(F.col("key"), F.lit(2)).otherwise(F.lit(0))}).withColumn("n", F.ceil((F.octet_length("unit") + F.col("lead")) / ROOM).cast("long"))
    counted = blocked.running(units, ["uri", "stream_index"], "at", blocked.ORDINALS, sent=("sum_before", F.col("n")))
    cut = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("cell"))
    begin = F.greatest(F.col("cell") * ROOM - F.col("lead"), F.lit(0)).cast("int")
    size = F.when(F.col("cell") == 0, F.lit(ROOM) - F.col("lead")).otherwise(F.lit(ROOM)).cast("int")
    cut = cut.withColumn("part", F.substring("unit", begin + 1, size)).withColumn("pad", F.lit(ROOM) - F.octet_length("part"))
    starts = F.when(F.col("cell") == 0, F.lit(0x4000)).otherwise(F.lit(0))
    control = F.when(F.col("pad") > 0, F.lit(0x30)).otherwise(F.lit(0x10)) + F.pmod(F.coalesce("sent", F.lit(0)) + F.col("cell"), F.lit(16))
    flags = F.when(F.col("key") & (F.col("cell") == 0), F.lit(0x40)).otherwise(F.lit(0))
    stuffing = F.unhex(F.repeat(F.lit("FF"), F.greatest(F.col("pad") - 2, F.lit(0))))
    field = F.when(F.col("pad") == 0, F.lit(b"")).when(F.col("pad") == 1, F.lit(b"\0")).otherwise(F.concat(_bytes(F.col("pad") - 1, 2), _bytes(flags, 2), stuffing))
    cells = cut.select("uri", "at", F.col("cell").cast("int").alias("cell"), F.concat(F.lit(b"\x47"), _bytes(starts + FIRST_PID + F.col("stream_index"), 4), _bytes(control, 2), field, F.col("part")).alias("data"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(uri, -1, i, cell) for uri, streams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, cell in enumerate(head_tables(streams))]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.binary()))], names=["uri", "at", "cell", "data"])

    files = packets.groupBy("uri").agg(F.sort_array(F.collect_set("stream_index")).alias("streams"))
    return cells.unionByName(files.mapInArrow(heads, "uri string, at long, cell int, data binary"))


def mux_ts(packets: DataFrame) -> DataFrame:
    """(uri, data): one transport stream per uri; a file is one ordered group."""

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        ordered = rows.sort_by([("at", "ascending"), ("cell", "ascending")])
        return pa.table({"uri": pa.array([key[0].as_py()], pa.string()), "data": pa.array([b"".join(ordered.column("data").to_pylist())], pa.binary())})

    return ts_cells(packets).groupBy("uri").applyInArrow(write, "uri string, data binary")
