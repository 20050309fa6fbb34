"""WARC archives: captures written as response and revisit records, read back, and indexed in order.

Writing.  A digest of every payload finds equal ones; only rows of repeated digests
meet, hot ones by broadcast.  Of equal payloads of ``least_bytes`` or more the one
with the largest id is a response and the others revisit it; all others are
responses.  A record's block is the HTTP header, which states the payload's length,
and for a response the payload.  Records are texts between line ends of CR LF CR LF,
so Spark's own text writer makes valid archives (gzip, one a task), with its commit
protocol, in any store that it reaches.

Reading.  A gzip file is never split, so a task sees it from its start.  Lines of
the text reader are put together again to the byte stream, and Content-Length alone
says where a block ends: a payload may hold anything.  Response payloads are held
against the lengths and digests that their headers state.

Index.  Every reading task is a run, sorted by (URL key, time, id, file, offset).
Rows are dealt to ranges of that key, each a few RANGE_ROWS long however many
captures an address has; a range merges its runs through a loser tree, and the
ranges follow one another, so ``position`` orders all captures.

Cases: a null payload is empty; a null address has no target header and the key '';
line ends in an address are percent-encoded; a null id is written as "none", never
referred to, and revisits its payload's largest id, if there is one; rows that share
an id and payload are responses together or revisits together; other columns are
ignored; an empty table makes an archive without records and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import cut, schema_with, shared_folder, small_batches
from .twins import Twins

END = "\r\n\r\n"
#: The alphabet of base32, the profile of revisits of equal payloads.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Index rows meant for a range.
RANGE_ROWS = 50_000
RECORD = "file string, offset long, length long, record_type string, record_id string, target string, captured string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base32: every 5 hex digits are 4 characters."""
    parts = []
    for i in range(0, 40, 5):
        bits = F.conv(F.substring(F.sha1(data), i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def with_references(captures: DataFrame, least_bytes: int = 0) -> DataFrame:
    """captures (id long, url, captured timestamp, payload string) with digest and refers_to (null: a response)."""
    payload = F.coalesce("payload", F.lit("")).cast("binary")
    sha = F.sha2(payload, 256)
    marked = captures.withColumns({"bytes": F.octet_length(payload).cast("long"), "_sha": F.when(F.octet_length(payload) >= least_bytes, sha)})
    marked = marked.withColumn("_print", F.conv(F.substring("_sha", 1, 15), 16, 10).cast("long"))
    known = cut(marked.where("_sha IS NOT NULL").select("id", "_sha", "_print"))
    found = Twins(known, "_sha", "_print", "id", F.max).beside(marked)
    return found.withColumn("refers_to", F.when(F.coalesce(F.col("best") > F.col("id"), F.col("best").isNotNull() & F.col("id").isNull()), F.col("best"))).drop("_sha", "_print", "best")


def records(captures: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(record string): whole WARC records of captures, without the line ends after them."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise("")
    urn = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    rows = with_references(captures, least_bytes).withColumn("payload", F.coalesce("payload", F.lit("")))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = rows.withColumns({"http": http, "digest": base32_sha1(F.col("payload").cast("binary"))})
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Target-URI", target),
        line("WARC-Date", F.date_format(F.to_utc_timestamp(F.coalesce("captured", F.timestamp_seconds(F.lit(0))), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("refers_to")))),
        line("WARC-Profile", F.when(revisit, F.lit(SAME_PAYLOAD))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response"),
        line("Content-Length", (F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
    )
    return rows.select(F.concat(head, F.lit(END), F.col("http"), F.when(revisit, "").otherwise(F.col("payload"))).alias("record"))


def write_archives(captures: DataFrame, path: str, least_bytes: int = 0) -> None:
    """One gzip archive a task in the folder ``path``, which must not exist."""
    records(captures, least_bytes).write.option("lineSep", END).option("compression", "gzip").text(path)


class RecordStream:
    """Cuts a byte stream into records, whatever pieces it comes in."""

    def __init__(self, file: str):
        self.file, self.at, self.parts, self.size, self.head, self.wanted = file, 0, [], 0, None, 0

    def feed(self, piece: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """(offset, headers in lower case, block) of the records that ``piece``, the bytes before a line end of CR LF CR LF, completes."""
        self.parts += [piece, b"\r\n\r\n"]
        self.size += len(piece) + 4
        if self.head is not None and self.size < self.wanted:
            return
        data = b"".join(self.parts)
        while True:
            if self.head is None:
                end = data.find(b"\r\n\r\n")
                if end < 0:
                    break
                lines = data[:end].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"{self.file} has no record at {self.at}")
                self.head = {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
                self.start, self.wanted = end + 4, end + 8 + int(self.head["content-length"])
            if len(data) < self.wanted:
                break
            if data[self.wanted - 4 : self.wanted] != b"\r\n\r\n":
                raise ValueError(f"{self.file} has no end of the record at {self.at}")
            yield self.at, self.head, data[self.start : self.wanted - 4]
            self.at += self.wanted
            data, self.head = data[self.wanted :], None
        self.parts, self.size = [data], len(data)

    def close(self) -> None:
        if self.size:
            raise ValueError(f"{self.file} ends inside the record at {self.at}")


def _number(urn: str | None) -> str | None:
    return None if urn is None else urn.removeprefix("<urn:capture:").removesuffix(">")


def _row(file: str, offset: int, head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (stated != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{file}: the payload at {offset} is not the one that was written")
    return file, offset, len(block), head["warc-type"], _number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-date"], _number(head.get("warc-refers-to")), digest, stated, payload if with_payload else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """RECORD of every record; payload is null for revisits, and for all without ``payloads``."""
    lines = small_batches(spark.read.option("lineSep", END).text(path)).select("_metadata.file_path", F.col("value").cast("binary").alias("piece"))
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = None
        for batch in batches:
            rows = []
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if stream is None or stream.file != file:
                    if stream is not None:
                        stream.close()
                    stream = RecordStream(file)
                rows += [_row(file, *found, payloads and found[1]["warc-type"] == "response") for found in stream.feed(piece)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        if stream is not None:
            stream.close()

    return lines.mapInArrow(parse, RECORD)


def url_key(url: Column) -> Column:
    """The address as a sort key: host labels from the right, then path and query, in lower case; '' without one."""
    low = F.lower(F.coalesce(url, F.lit("")))
    bare = F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(?:www\d{0,3}\.)?", "")
    host, rest = F.regexp_extract(bare, r"^([^/:?#]*)", 1), F.regexp_extract(bare, r"^[^/?#]*([^#]*)", 1)
    return F.when(bare == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest)))


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, so the next row costs one path to the root."""

    def __init__(self, runs: list[list]):
        self.runs, self.next, k = runs, [0] * len(runs), max(1, len(runs))
        self.losers = [-1] * k  # losers[0] is the winner of all
        winners = [-1] * k + list(range(len(runs))) + [-1] * (k - len(runs))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.losers[0] = winners[1] if k > 1 else (0 if runs else -1)

    def _before(self, a: int, b: int) -> bool:
        if a < 0 or self.next[a] >= len(self.runs[a]):
            return False
        return b < 0 or self.next[b] >= len(self.runs[b]) or self.runs[a][self.next[a]] <= self.runs[b][self.next[b]]

    def __iter__(self) -> Iterator:
        while (run := self.losers[0]) >= 0 and self.next[run] < len(self.runs[run]):
            yield self.runs[run][self.next[run]]
            self.next[run] += 1
            winner, node = run, (run + len(self.runs)) // 2
            while node >= 1:
                if self._before(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.losers[0] = winner


def merged_index(read: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """read (RECORD, checkpointed, its payload left out) with url_key and position, the place of a capture in the order of all."""
    rows = read.select(*[c for c in read.columns if c != "payload"], url_key(F.col("target")).alias("url_key"), F.coalesce(F.expr("try_cast(record_id AS long)"), F.lit(-(2**63))).alias("_id"))
    order = ["url_key", "captured", "_id", "file", "offset"]
    # Locally sorted runs, one a task; ranges then get their part of every run.
    runs = rows.sortWithinPartitions(*order).withColumn("_run", F.monotonically_increasing_id())
    ranges = max(1, -(-read.count() // range_rows))
    dealt = small_batches(runs.repartitionByRange(ranges, *order))
    names, schema = dealt.columns, schema_with(dealt.drop("_run", "_id"), "_range int, _place long")
    at = [names.index(c) for c in order]
    run, kept = names.index("_run"), [i for i, c in enumerate(names) if c not in ("_run", "_id")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        found = pa.Table.from_batches(table)
        parts: dict[int, list] = {}
        for i, (number, *place) in enumerate(zip(*(found.column(c).to_pylist() for c in (run, *at)))):
            parts.setdefault(number >> 33, []).append((number, (*place, i)))
        # the number within a run is the order in which it was sorted, so sorting by it only undoes the fetches' order
        tree = LoserTree([[key for _, key in sorted(part)] for part in parts.values()])
        taken = found.take(pa.array([key[-1] for key in tree], pa.int64()))
        here = TaskContext.get().partitionId()
        columns = [*(taken.column(i) for i in kept), pa.array([here] * len(taken), pa.int32()), pa.array(range(len(taken)), pa.int64())]
        yield from pa.table(columns, names=schema.names).to_batches(10_000)

    merged = cut(dealt.mapInArrow(merge, schema))
    sizes = dict(merged.groupBy("_range").count().collect())  # one row a range
    before, total = {}, 0
    for number in sorted(sizes):
        before[number], total = total, total + sizes[number]
    starts = read.sparkSession.createDataFrame(list(before.items()), "_range int, _before long")
    return merged.join(F.broadcast(starts), "_range").withColumn("position", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def archived(captures: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """The ordered index of captures (id long, url, captured timestamp, payload string), written to archives and read back.

    path: the archives' folder; null is a new one in the shared folder.
    """
    spark = captures.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(captures, path, least_bytes)
    return merged_index(cut(read_archives(spark, path, payloads=False)))


def page_captures(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages as captures; the table has no time, so the lowest 32 bits of an id are the second of its capture."""
    page = F.col(key).cast("long")
    return pages.select(page.alias("id"), "url", F.timestamp_seconds(F.pmod(F.coalesce(page, F.lit(0)), F.lit(1 << 32))).alias("captured"), F.col("html").alias("payload"))
