"""MPEG transport streams as a Spark data source: read in byte ranges, written in segments, streamed, sought by an index.

A title is a folder of segments whose names sort in the stream's order.  A range of
whole cells is a task: it cuts the packets that begin in it, and gives the last
packet of every stream, which may go on, and what goes on from before as pieces of
their own.  Only those few pieces are shuffled, to be joined again.

Files are reached through pyarrow's file systems, so the path is a local folder or
any address that these know.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators import blocked, timeline
from .datasource import PACKET_FIELDS
from .transport import CELL, ts_cells

FORMAT, RANGE_BYTES = "framelake_segments", 64 << 20
#: kind: whole (a packet that ends in its range), open (the last one of its stream), rest (bytes before a stream's first packet).
PIECES = "title string, file string, at long, pid int, offset long, end long, kind string, pts long, keyframe boolean, data binary"
CELLS = "uri string, at long, cell int, data binary"
_PIECE_SCHEMA = pa.schema([("title", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("pid", pa.int32()), ("offset", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("pts", pa.int64()), ("keyframe", pa.bool_()), ("data", pa.binary())])


def _timestamp(payload: bytes) -> int | None:
    if not payload[7] & 0x80:
        return None
    b = payload[9:14]
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def cut_range(data: bytes, base: int) -> list[tuple]:
    """(pid, offset, end, kind, pts, keyframe, data) of the pieces in cells that begin at byte ``base`` of their file; offset to end are the bytes that hold a piece."""
    cells = np.frombuffer(data, np.uint8)[: len(data) // CELL * CELL].reshape(-1, CELL)
    if (cells[:, 0] != 0x47).any():
        raise ValueError(f"lost sync at {base + CELL * int(np.argmax(cells[:, 0] != 0x47))}")
    pids = (cells[:, 1].astype(np.int32) & 0x1F) << 8 | cells[:, 2]
    control, longer = cells[:, 3] >> 4 & 3, cells[:, 4].astype(np.int32)
    begins = np.where(control & 2, 5 + longer, 4)
    random_access = (control & 2 > 0) & (longer > 0) & (cells[:, 5] & 0x40 > 0)
    units: dict[int, list[list]] = {}
    for i in np.flatnonzero((control & 1 > 0) & (begins < CELL)).tolist():
        pid, payload = int(pids[i]), data[i * CELL + int(begins[i]) : (i + 1) * CELL]
        mine = units.setdefault(pid, [[base, base, "rest", None, False, []]])
        end = base + (i + 1) * CELL
        if cells[i, 1] & 0x40:
            if payload[:3] == b"\0\0\1":
                mine[-1][2] = "whole" if mine[-1][2] == "open" else mine[-1][2]
                mine.append([base + i * CELL, end, "open", _timestamp(payload), bool(random_access[i]), [payload[9 + payload[8] :]]])
        else:
            mine[-1][1] = end
            mine[-1][5].append(payload)
    return [(pid, *piece[:5], b"".join(piece[5])) for pid, mine in units.items() for piece in mine if piece[2] != "rest" or piece[5]]


def read_range(file: str, title: str, at: int, length: int) -> pa.RecordBatch:
    """The pieces of one byte range."""
    store, path = fs.FileSystem.from_uri(file)
    with store.open_input_file(path) as f:
        rows = [(title, file, at, *piece) for piece in cut_range(f.read_at(length, at), at)]
    columns = list(zip(*rows)) if rows else [()] * len(_PIECE_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _PIECE_SCHEMA)], schema=_PIECE_SCHEMA)


def listed(path: str) -> list[tuple[str, str, int]]:
    """(title, file, bytes) of every segment under path, in the order of their names."""
    store, root = fs.FileSystem.from_uri(path)
    scheme = path[: -len(root)] if path.endswith(root) else ""
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    segments = [(i.path.rsplit("/", 2)[-2], i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.endswith(".ts") and "/_pending-" not in i.path]
    return [(unquote(title), scheme + file, size) for title, file, size in sorted(segments)]


@dataclass
class Range(InputPartition):
    file: str
    title: str
    at: int
    length: int


def _ranges(files: list[tuple[str, str, int]], size: int) -> list[Range]:
    step = max(CELL, size // CELL * CELL)
    return [Range(file, title, at, min(step, total - at)) for title, file, total in files for at in range(0, total, step)]


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        return _ranges(listed(self.path), self.size) or [Range("", "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.length:
            yield read_range(partition.file, partition.title, partition.at, partition.length)


class _StreamReader(DataSourceStreamReader):
    """An offset is the last segment's name of every title: segments are added at a title's end, whole."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {title: file.rsplit("/", 1)[-1] for title, file, _ in listed(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        fresh = [f for f in listed(self.path) if start.get(f[0], "") < f[1].rsplit("/", 1)[-1] <= end.get(f[0], "")]
        return _ranges(fresh, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield read_range(partition.file, partition.title, partition.at, partition.length)

    def commit(self, end: dict) -> None: ...


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Every task writes its part of each title under a name of its own attempt; only what the job commits is moved to its place."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex
        self.first = 0 if overwrite else 1 + max((int(file.rsplit("/", 1)[-1][:8]) for _, file, _ in listed(path)), default=-1)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark.taskcontext import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(self.path)
        files, out, now = [], None, None
        for batch in iterator:
            for uri, data in zip(batch.column("uri").to_pylist(), batch.column("data").to_pylist()):
                if out is None or uri != now:
                    if out is not None:
                        out.close()
                    title, now = quote(uri, safe=""), uri
                    name = f"{self.first + context.partitionId():08d}.ts"
                    pending = f"{root}/_pending-{self.job}/{context.taskAttemptId()}"
                    store.create_dir(f"{pending}/{title}", recursive=True)
                    out = store.open_output_stream(f"{pending}/{title}/{name}")
                    files.append((f"{pending}/{title}/{name}", f"{root}/{title}/{name}"))
                out.write(data)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for _, file, _ in listed(self.path):
                store.delete_file(fs.FileSystem.from_uri(file)[1])
        for pending, final in (pair for m in messages if m is not None for pair in m.files):
            store.create_dir(final.rsplit("/", 1)[0], recursive=True)
            store.move(pending, final)
        self._clear(store, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        pending = f"{root}/_pending-{self.job}"
        if store.get_file_info(pending).type == fs.FileType.Directory:
            store.delete_dir(pending)


class SegmentSource(DataSource):
    """Options: path, and rangeBytes for readers."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PIECES

    def _size(self) -> int:
        return int(self.options.get("rangebytes", RANGE_BYTES))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self._size())

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self.options["path"], self._size())

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def write_titles(packets: DataFrame, path: str, segments: int, mode: str = "append") -> None:
    """Packets (see ts_cells) as titles of ``segments`` segments in all: cells are dealt by range, so no file is one task's."""
    packets.sparkSession.dataSource.register(SegmentSource)
    cells = ts_cells(packets).repartitionByRange(segments, "uri", "at", "cell").sortWithinPartitions("uri", "at", "cell")
    cells.write.format(FORMAT).mode(mode).save(path)


def joined(pieces: DataFrame) -> DataFrame:
    """(title, file, offset, pid, pts, keyframe, extents, data): the packets of PIECES, those cut by a boundary put together.

    extents: array<struct<file, offset, length>>, the bytes that hold the packet.
    """
    cut = pieces.where("kind <> 'whole'")
    seen = Window.partitionBy("title", "pid").orderBy("file", "at", F.col("kind") == "open").rowsBetween(Window.unboundedPreceding, 0)
    owned = cut.withColumn("owner", F.last(F.when(F.col("kind") == "open", F.struct("file", "offset", "pts", "keyframe")), ignorenulls=True).over(seen)).where("owner IS NOT NULL")
    parts = F.sort_array(F.collect_list(F.struct("file", "at", F.col("kind") != "open", "offset", "end", "data")))
    whole = owned.groupBy("title", "pid", "owner").agg(parts.alias("parts"))
    data = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["data"]))
    extent = lambda x: F.struct(x["file"].alias("file"), x["offset"].alias("offset"), (x["end"] - x["offset"]).alias("length"))
    again = whole.select("title", "owner.file", "owner.offset", "pid", "owner.pts", "owner.keyframe", F.transform("parts", extent).alias("extents"), data.alias("data"))
    here = F.array(extent({c: F.col(c) for c in ("file", "offset", "end")}))
    return pieces.where("kind = 'whole'").select("title", "file", "offset", "pid", "pts", "keyframe", here.alias("extents"), "data").unionByName(again)


def read_pieces(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """PIECES of every title under path, read in ranges of about range_bytes."""
    spark.dataSource.register(SegmentSource)
    return spark.read.format(FORMAT).option("rangeBytes", range_bytes).load(path)


def read_titles(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """joined() of every title's pieces, for which the ranges are cut twice."""
    return joined(read_pieces(spark, path, range_bytes))


def as_packets(units: DataFrame) -> DataFrame:
    """Packet rows of joined() units: streams are numbered in the order in which they begin."""
    first = units.groupBy("title", "pid").agg(F.min(F.struct("file", "offset")).alias("begin"))
    streams = first.select("title", "pid", (F.row_number().over(Window.partitionBy("title").orderBy("begin")) - 1).alias("stream_index"))
    long = lambda v: F.lit(v).cast("long")
    rows = units.join(streams, ["title", "pid"]).select(F.col("title").alias("uri"), "stream_index", long(1).alias("tb_num"), long(90_000).alias("tb_den"), "pts", long(None).alias("dts"), long(None).alias("duration"), "keyframe", "data")
    return rows.select(*[f.split()[0] for f in PACKET_FIELDS.split(", ")])


# Seeking


def seek_index(units: DataFrame, every: int = 1) -> DataFrame:
    """(title, pid, ticks, file, offset, extents): every so many keyframes of each stream of joined() units, by their times with wraps undone.

    Written as a table it is a small part of the archive, and nothing else is read to
    find a place.  units are read several times, so what they are without their data
    should be a table first.
    """
    rows = units.where("pts IS NOT NULL").select("title", "pid", "file", "offset", "pts", "keyframe", "extents").withColumn("stream", F.concat_ws("/", "title", "pid"))
    # segments are numbered by eight digits, so a place in the title is one number
    rows = rows.withColumn("place", F.regexp_extract("file", r"(\d+)\.ts$", 1).cast("long") * (1 << 36) + F.col("offset"))
    timed = timeline.unwrap(rows, "stream", "place", "pts", width=float(1 << 42))
    keys = blocked.running(timed.where("keyframe"), "stream", "place", float(1 << 42), n=("count_before", F.lit(1)))
    return keys.where(F.pmod("n", F.lit(every)) == 0).select("title", "pid", F.col("unwrapped").alias("ticks"), "file", "offset", "extents")


def indexed(index: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (title, pid, target) with the indexed keyframe at or before each (ticks, file, offset, extents; null where there is none): one union and one window."""
    keys = index.select("title", "pid", F.col("ticks").alias("t"), F.struct("ticks", "file", "offset", "extents").alias("key"), F.lit(0).alias("side"))
    asked = targets.select("title", "pid", F.col("target").alias("t"), F.lit(None).cast(keys.schema["key"].dataType).alias("key"), F.lit(1).alias("side"))
    last = Window.partitionBy("title", "pid").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = keys.unionByName(asked).withColumn("key", F.last("key", ignorenulls=True).over(last)).where("side = 1")
    return found.select("title", "pid", F.col("t").alias("target"), "key.*")


def read_extents(wanted: DataFrame) -> DataFrame:
    """PIECES of the extents (title, pid, file, offset, length), of their own stream only; each is read once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for title, pid, file, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                found = read_range(file, title, at, length)
                yield found.filter(pa.array([p == pid for p in found.column("pid").to_pylist()], pa.bool_()))

    return wanted.select("title", "pid", "file", "offset", "length").distinct().mapInArrow(read, PIECES)


def seek(index: DataFrame, targets: DataFrame) -> DataFrame:
    """(title, pid, target, ticks, pts, data): the keyframe with which decoding starts for each target; of the archive only its extents are read."""
    found = indexed(index, targets)
    units = joined(read_extents(found.select("title", "pid", F.explode("extents").alias("e")).select("title", "pid", "e.*")))
    return found.drop("extents").join(units.select("title", "pid", "file", "offset", "pts", "data"), ["title", "pid", "file", "offset"], "left").select("title", "pid", "target", "ticks", "pts", "data")
