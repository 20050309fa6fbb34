"""Cross-tokenizer alignment: groups of tokens of two tokenizers that end at one byte, and how often id pairs are linked.

1. Each text is encoded by both tokenizers.  A label string has one letter a byte:
   n (no token ends), a (one of A), b (one of B), c (both).  A regular expression
   takes spans up to each c; the labels in a span count the tokens of its group.
   Of every text its numbers, the digest of its groups and its distinct linked id
   pairs stay, with their occurrences.
2. The count of a pair is the number of texts that hold it: tasks add up what they
   see before the shuffle.  The highest count of each id of A has one row an id.
3. Every text's links meet the counts of their pairs.  At most MOST_PAIRS counts,
   the highest, go by broadcast; where there are more pairs, the others are joined
   by shuffle, and none of them can be hot, as more than MOST_PAIRS are more frequent.

Cases: a text that is null or empty, or whose tokens do not spell it (a tokenizer
that normalises), has no tokens: all numbers 0, the digest ''; special tokens'
strings are plain text; a very long text is encoded as a whole, and its pairs are
held by one task (a group of m and n tokens has m * n links, counted by distinct
ids when there are many); repeated rows count as texts of their own; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import cut, schema_with, small_batches
from .kernels import row_sums

#: Pairs whose counts are broadcast (12 bytes each), pairs that a task adds up before it sends them, links laid out at once.
MOST_PAIRS, TASK_PAIRS, MOST_LINKS = 1 << 21, 1 << 21, 1 << 20
#: A group of more links is counted by distinct ids.
WIDE_GROUP = 1 << 14
LETTERS = np.frombuffer(b"nabc", np.uint8)
_SPAN = re.compile(rb"[ab]*c")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_level_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Spelling:
    """The bytes of every id of a vocabulary, end to end."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(x) for x in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the ids, where each id ends)."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[np.arange(ends[-1] if len(ids) else 0) + np.repeat(self.starts[ids] - ends + sizes, sizes)], ends


class Encoders:
    """Both tokenizers, with the bytes of every id.

    A: texts of Latin letters go through tiktoken, which holds the same vocabulary
    as ranks and gives the same ids faster; all others through tokenizers.
    """

    def __init__(self, a_path: str | None = None, b_path: str | None = None, ranks_path: str | None = None):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(a_path or public_tokenizers.path("byte_bpe_50k.json"))
        self.slow.encode_special_tokens = True
        self.fast, self.unusual = None, re.compile("[^\x00-ɏ‐-›]")
        if ranks_path or a_path is None:
            with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path("piece_bpe_32k.model"))
        value = byte_level_table()
        spelt = [self.slow.id_to_token(i) or "" for i in range(self.slow.get_vocab_size())]
        a_bytes = [bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t in spelt]
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in names]
        self.a, self.b = Spelling(a_bytes), Spelling(b_bytes)
        # ids as text, with what follows them inside a group and at its end
        self.a_names, self.b_names = (np.array([f"{i}{c}" for i in range(len(table)) for c in f",{end}"], object) for table, end in ((a_bytes, "|"), (b_bytes, ";")))

    @property
    def sizes(self) -> tuple[int, int]:
        """Entries of both vocabularies."""
        return len(self.a.sizes), len(self.b.sizes)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids of A, where each ends, ids of B, where each ends), or None where a side does not spell space + text."""
        if not text:
            return None
        spaced = f" {text}"
        if self.fast is None or self.unusual.search(text):
            a = np.array(self.slow.encode(spaced, add_special_tokens=False).ids, np.int64)
        else:
            a = np.array(self.fast.encode_ordinary(spaced), np.int64)
        b, want = np.array(self.pieces.encode(text), np.int64), np.frombuffer(spaced.encode(), np.uint8)
        (a_spelt, a_ends), (b_spelt, b_ends) = self.a.of(a), self.b.of(b)
        return (a, a_ends, b, b_ends) if np.array_equal(a_spelt, want) and np.array_equal(b_spelt, want) else None


class _Counts(dict):
    """Tokens of A and of B of a span by its labels, as one number."""

    def __missing__(self, span: bytes) -> int:
        out = (span.count(b"a") + 1 << 32) + span.count(b"b") + 1
        if len(span) < 16:
            self[span] = out
        return out


_COUNTS = _Counts()


def group_sizes(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B in each group, from the label string of a text; both end with its last byte."""
    labels = np.zeros(a_ends[-1], np.uint8)
    labels[a_ends - 1] = 1
    labels[b_ends - 1] += 2
    ends = LETTERS[labels].tobytes().translate(None, b"n")  # where no token ends nothing is counted
    sizes = np.fromiter(map(_COUNTS.__getitem__, _SPAN.findall(ends)), np.int64)
    return sizes >> 32, sizes & 0xFFFFFFFF


def shown_groups(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, e: Encoders) -> str:
    """a1,a2|b1;a3|b2,b3: every id stands behind those of earlier groups and, for B, behind its group's ids of A."""
    a_ends, b_ends = np.cumsum(na), np.cumsum(nb)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[a_ends - 1] = 1
    last_b[b_ends - 1] = 1
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + np.repeat(b_ends - nb, na)] = e.a_names[2 * a + last_a]
    out[np.arange(len(b)) + np.repeat(a_ends, nb)] = e.b_names[2 * b + last_b]
    return "".join(out.tolist())[:-1]


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted codes and the sums of their counts."""
    joined, weight = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(joined, kind="stable")
    joined, weight = joined[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]])) if len(joined) else np.empty(0, np.int64)
    return joined[first], np.add.reduceat(weight, first) if len(first) else weight


def linked_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes a * width + b, occurrences) of the distinct pairs linked in the groups, codes ascending."""
    a_at, b_at, links = np.cumsum(na) - na, np.cumsum(nb) - nb, na * nb
    codes, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for g in np.flatnonzero(links > WIDE_GROUP):
        ua, ca = np.unique(a[a_at[g] : a_at[g] + na[g]], return_counts=True)
        ub, cb = np.unique(b[b_at[g] : b_at[g] + nb[g]], return_counts=True)
        codes.append((ua[:, None] * width + ub).ravel())
        counts.append(np.outer(ca, cb).ravel())
    narrow = np.flatnonzero(links <= WIDE_GROUP)
    ends = np.cumsum(links[narrow])
    at = 0
    while at < len(narrow):  # slices of MOST_LINKS links
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_LINKS, side="right")))
        some = narrow[at:to]
        n = links[some]
        g = np.repeat(some, n)
        within = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
        found, times = np.unique(a[a_at[g] + within // nb[g]] * width + b[b_at[g] + within % nb[g]], return_counts=True)
        codes.append(found)
        counts.append(times)
        at = to
    return (codes[1], counts[1]) if len(codes) == 2 else _added(codes, counts)


STATS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(key, _uid, STATS, _codes, _at, _more binary) of every row: its distinct pairs, and at which of them it has more occurrences than one.

    A code is a * size of B's vocabulary + b.
    """
    source = small_batches(docs).select(F.col(key), F.col(text).alias("_text"))
    schema = schema_with(source.select(key), f"_uid long, {STATS}, _codes binary, _at binary, _more binary")
    types = [pa.int64()] * 5 + [pa.string()] + [pa.binary()] * 3

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, uid = Encoders(a_path, b_path, ranks_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for value in batch.column(1):
                found = e.encode(value.as_py() or "")
                if found is None:
                    rows.append((uid, 0, 0, 0, 0, "", b"", b"", b""))
                else:
                    a, a_ends, b, b_ends = found
                    na, nb = group_sizes(a_ends, b_ends)
                    codes, times = linked_pairs(a, b, na, nb, e.sizes[1])
                    more = np.flatnonzero(times > 1)
                    digest = hashlib.sha256(shown_groups(a, b, na, nb, e).encode()).hexdigest()
                    rows.append((uid, len(a), len(b), len(na), int(na @ nb), digest, codes.astype("<i8" if e.sizes[0] * e.sizes[1] >> 32 else "<u4").tobytes(), more.astype("<u4").tobytes(), (times[more] - 1).astype("<u8").tobytes()))
                uid += 1
            columns = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=schema.names)

    return source.mapInArrow(align, schema)


def _codes_of(column: pa.Array, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all rows, row bounds)."""
    raw = [x.as_buffer() for x in column]
    kind = np.dtype("<i8" if wide else "<u4")
    bounds = np.cumsum([0, *(x.size // kind.itemsize for x in raw)])
    parts = [np.frombuffer(x, kind) for x in raw if x.size]
    return (np.concatenate(parts) if parts else np.empty(0, kind)).astype(np.int64), bounds


def pair_counts(rows: DataFrame, wide: bool) -> DataFrame:
    """(code long, n long): how many rows hold each pair; tasks add up TASK_PAIRS and more before they send."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = kept = 0  # codes waiting, and those of them that the last addition left

        def sums() -> tuple[np.ndarray, np.ndarray]:
            return _added([c for c, _ in waiting], [n for _, n in waiting])

        def send(found: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in found], names=["code", "n"])

        for batch in batches:
            codes, _ = _codes_of(batch.column(0), wide)
            if not len(codes):
                continue
            found = np.unique(codes, return_counts=True)
            waiting.append(found)
            held += len(found[0])
            if held - kept > TASK_PAIRS:
                found = sums()
                if len(found[0]) > TASK_PAIRS:
                    yield from send(found)
                    waiting, held, kept = [], 0, 0
                else:
                    waiting, held, kept = [found], len(found[0]), len(found[0])
        if waiting:
            yield from send(sums())

    return rows.select("_codes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _collected(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and their counts on the driver, as packed arrays; counts has a checked number of rows."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        packed = [pa.array([rows.column(c).to_numpy().astype("<i8").tobytes()], pa.binary()) for c in ("code", "n")]
        return pa.table(packed, names=["codes", "counts"])

    found = counts.groupBy(F.pmod("code", F.lit(64)).alias("_part")).applyInArrow(pack, "codes binary, counts binary").collect()
    codes, n = (np.concatenate([np.frombuffer(bytes(r[i]), "<i8") for r in found]) if found else np.empty(0, np.int64) for i in (0, 1))
    order = np.argsort(codes)
    return codes[order], n[order]


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None, ranks_path: str | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum long, groups_sha256) of every row."""
    vocabulary = Encoders(a_path, b_path, ranks_path)
    height, width = vocabulary.sizes
    wide = bool(height * width >> 32)
    rows = cut(aligned(docs, key, text, a_path, b_path, ranks_path))
    counts = cut(pair_counts(rows, wide))
    best = np.zeros(height, np.int64)
    for a, n in counts.groupBy(F.expr(f"code div {width}")).agg(F.max("n")).collect():  # a row an id of A
        best[a] = n
    # Counts of ``least`` and more are broadcast: all, or those above a power of two.
    sizes = dict(counts.groupBy(F.floor(F.log2("n")).cast("int")).count().collect())
    least, known = 1 << (max(sizes, default=0) + 1), 0
    for power in sorted(sizes, reverse=True):
        if known + sizes[power] > most_pairs:
            break
        known, least = known + sizes[power], 1 << power
    rest = known < sum(sizes.values())
    shared = docs.sparkSession.sparkContext.broadcast((*_collected(counts.where(F.col("n") >= least)), best))

    def looked_up(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, ...]:
        """Codes, row bounds, occurrences and known counts (0: not known) of a batch's pairs."""
        keys, n, _ = shared.value
        codes, bounds = _codes_of(batch.column(first), wide)
        times = np.ones(len(codes), np.int64)
        for row, (at, more) in enumerate(zip(batch.column(first + 1), batch.column(first + 2))):
            if at.as_buffer().size:
                times[bounds[row] + np.frombuffer(at.as_buffer(), "<u4")] += np.frombuffer(more.as_buffer(), "<u8").astype(np.int64)
        if not len(keys):
            return codes, bounds, times, np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return codes, bounds, times, np.where(keys[at] == codes, n[at], 0)

    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    pairs = ("_codes", "_at", "_more")
    out = rows.select(key, "_uid", *names, *pairs)
    schema = schema_with(out.drop(*pairs), "n_best long, count_sum long")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value[2]
        for batch in batches:
            codes, bounds, times, n = looked_up(batch, 7)
            sums = (row_sums(times * ((n > 0) & (n == top[codes // width])), bounds), row_sums(times * n, bounds))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *map(pa.array, sums)], names=schema.names)

    weighed = out.mapInArrow(weigh, schema)
    if rest:

        def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, bounds, times, n = looked_up(batch, 1)
                uid = np.repeat(batch.column(0).to_numpy(), np.diff(bounds))
                where = n == 0
                yield pa.RecordBatch.from_arrays([pa.array(x[where]) for x in (uid, codes, times)], names=["_uid", "code", "times"])

        tops = F.broadcast(counts.groupBy(F.expr(f"code div {width}").alias("_a")).agg(F.max("n").alias("_top")))  # a row an id of A
        few = counts.where(F.col("n") < least).withColumn("_a", F.expr(f"code div {width}")).join(tops, "_a")
        met = rows.select("_uid", *pairs).mapInArrow(unknown, "_uid long, code long, times long").join(few, "code")
        late = met.groupBy("_uid").agg(F.sum(F.when(F.col("n") == F.col("_top"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
        weighed = weighed.join(late, "_uid", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return weighed.select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
