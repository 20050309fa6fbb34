"""Audit of five document filters: what each removes in every order, alone, in vain, and wrongly.

1. One scan of the Arrow buffers: byte classes and their prefix sums give words,
   capitals, symbols and code points of every text of a batch at once.  Distinct
   words are counted from sorted hashes; neighbours of one hash are compared byte by
   byte, and a text in which they differ is counted again word by word.  A row keeps
   a mask of the filters it fails, and its text's digest.
2. Filter E needs the smallest doc_id of each text: only texts of repeated digests
   are shuffled, hot ones go by broadcast.
3. Masks reduce: (part, mask) counts, 32 a part at most, hold all that the orders
   ask for.  A matrix of orders and steps by masks turns them into the rows.

Filters: A under LEAST_WORDS words; B 100 * distinct < DISTINCT_SHARE * words; C
100 * capitals A-Z > CAPITAL_SHARE * code points; D any character of SYMBOLS; E the
text of a smaller doc_id, whether that is removed or not.

Cases: a null text is empty (it fails A, and E behind another empty text); a null
source is the part ''; a null doc_id is neither smaller nor larger than any other,
so it neither fails E nor makes another fail, and has no label; rows that share a
doc_id are counted each; of several labels of a doc_id any that says 1 counts;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .kernels import TextChunk, chunks, mix64, row_sums
from .twins import Twins

LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, SYMBOLS = 50, 65, 5, "#$%&*|"
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the byte runs of these lengths at a and at b are equal."""
    ends = np.cumsum(lengths)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    differ = data[np.repeat(a, lengths) + within] != data[np.repeat(b, lengths) + within]
    return row_sums(differ, np.concatenate([[0], ends])) == 0


def distinct_words(chunk: TextChunk, hashes: np.ndarray | None = None) -> np.ndarray:
    """Distinct words of every row: sorted hashes, with equal neighbours verified."""
    row = chunk.word_row
    keys = mix64((chunk.word_hashes() if hashes is None else hashes) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    twin = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    a, b = order[twin], order[twin + 1]
    lengths = chunk.ends - chunk.starts
    verified = (row[a] == row[b]) & (lengths[a] == lengths[b])
    fits = np.flatnonzero(verified)
    verified[fits] = _same_bytes(chunk.data, chunk.starts[a[fits]], chunk.starts[b[fits]], lengths[a[fits]])
    out = chunk.words_per_row - np.bincount(row[b[verified]], minlength=chunk.rows)
    for r in np.unique(np.concatenate([row[a[~verified]], row[b[~verified]]])):  # a hash of two words: hardly ever
        words = np.flatnonzero(row == r)
        out[r] = len({chunk.data[s:e].tobytes() for s, e in zip(chunk.starts[words], chunk.ends[words])})
    return out


def text_failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mask of A (1), B (2), C (4) and D (8) for every row."""
    chunk = TextChunk(data, offsets)
    words, distinct = chunk.words_per_row, distinct_words(chunk)
    capitals, points = row_sums(_CAPITAL[data], offsets), row_sums((data & 0xC0) != 0x80, offsets)
    fails = (words < LEAST_WORDS, 100 * distinct < DISTINCT_SHARE * words, 100 * capitals > CAPITAL_SHARE * points, row_sums(_SYMBOL[data], offsets) > 0)
    return sum(f.astype(np.int64) << i for i, f in enumerate(fails))


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(_id long, part string, mask int) of every row: bit i is set where the row fails filter i of ABCDE."""
    source = small_batches(docs).select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.col(text).alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(2)):
                mask = text_failures(data, offsets)
                digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
                prints = np.frombuffer(b"".join(d[:8] for d in digests), "<i8")
                columns = [batch.column(0).slice(first, len(mask)), batch.column(1).slice(first, len(mask)), pa.array(mask.astype(np.int32)), pa.array(digests, pa.binary()), pa.array(prints)]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "part", "mask", "_sha", "_print"])

    scanned = cut(source.mapInArrow(scan, "_id long, part string, mask int, _sha binary, _print long"))
    marked = Twins(scanned, "_sha", "_print", "_id", F.min).beside(scanned)
    again = F.coalesce(F.col("_id") > F.col("best"), F.lit(False))
    return marked.select("_id", "part", (F.col("mask") + F.when(again, 16).otherwise(0)).alias("mask"))


def step_table() -> dict[str, np.ndarray]:
    """For the 600 (order, step): which of the 32 masks the step keeps, removes, and would remove had they not gone before."""
    masks = np.arange(32)
    rows: dict[str, list] = {"order": [], "step": [], "filter": [], "kept": [], "removed": [], "redundant": []}
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            f = FILTERS.index(letter)
            fails, gone = (masks >> f & 1) == 1, (masks & before) > 0
            for name, value in (("order", order), ("step", step), ("filter", f), ("kept", ~fails & ~gone), ("removed", fails & ~gone), ("redundant", fails & gone)):
                rows[name].append(value)
            before |= 1 << f
    return {name: np.array(values) for name, values in rows.items()}


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step int, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley long): 600 rows a part.

    labels: (key, quality, toxic).
    """
    failed = cut(failures(docs, key, text, part))
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_id")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic")).where("good + toxic > 0")
    zero = F.lit(0).cast("long")
    counted = failed.select("part", "mask", F.lit(1).cast("long").alias("n"), zero.alias("good"), zero.alias("toxic"))
    labelled = failed.where("_id IS NOT NULL").join(known, "_id").select("part", "mask", zero.alias("n"), "good", "toxic")
    cells = counted.unionByName(labelled).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = step_table()
        bits = np.array([bin(m).count("1") for m in range(32)])
        share = len(ORDERS) // np.maximum(bits, 1)  # orders in which a filter stands before all others that a mask fails
        has = (np.arange(32)[None, :] >> np.arange(len(FILTERS))[:, None] & 1) == 1
        for batch in batches:
            for name, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, good, toxic = np.zeros((3, 32), np.int64)
                for cell in cells:
                    n[cell["mask"]], good[cell["mask"]], toxic[cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                f = steps["filter"]
                sums = (steps["kept"] @ n, steps["removed"] @ n, steps["redundant"] @ n, n[1 << f], steps["removed"] @ good, steps["removed"] @ toxic, (has @ (n * share))[f])
                columns = [pa.array([name] * len(f), pa.string()), pa.array(steps["order"].tolist(), pa.string()), pa.array(steps["step"].astype(np.int32)), *(pa.array(s.astype(np.int64)) for s in sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])

    return parts.mapInArrow(reduce, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")
