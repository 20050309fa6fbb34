"""Quality rules: counts, base rules and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted on all rows: the raw corpus
(every document) and the trusted target (every document labelled good).  A
document's score is the mean log ratio of its n-grams, target over raw, so its
length does not matter; a fixed threshold decides on every document.  Only the
two count vectors, of a fixed length, reach the driver and travel to the tasks.

Cases: a null or empty text has no words and fails; a text shorter than an n-gram
scores 0; with no trusted documents every score is 0 and only the base rules
decide; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import only, schema_with, small_batches
from .kernels import TextChunk, any_twin, chunks, earlier_twin, mix64, row_sums, windows

WIDTH, BUCKETS, SMOOTHING = 4, 1 << 16, 1.0
#: Buckets of one message, and first-step groups a chunk.
CHUNK, SALTS = 1 << 12, 256
#: Documents with a lower mean log ratio are dropped.
THRESHOLD = -0.35
LEAST_WORDS, MOST_REPEATED = 10, 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte n-gram, row bounds); n-grams never cross rows."""
    lengths = np.maximum(np.diff(offsets) - (WIDTH - 1), 0)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    if not bounds[-1]:
        return np.empty(0, np.int64), bounds
    code = np.zeros(len(data) - WIDTH + 1, np.uint64)
    for i in range(WIDTH):
        code = code << np.uint64(8) | data[i : len(data) - WIDTH + 1 + i].astype(np.uint64)
    if len(offsets) > 2:
        ok = np.ones(len(code) + WIDTH, bool)
        for i in range(1, WIDTH):
            last = offsets[1:] - i
            ok[last[last >= offsets[:-1]]] = False
        code = code[ok[: len(code)]]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 16)).astype(np.int64), bounds


def text_counts(chunk: TextChunk) -> dict[str, np.ndarray]:
    """The five counts of each row."""
    data, offsets, bounds = chunk.data, chunk.offsets, chunk.word_bounds
    starts_char = (data & 0xC0) != 0x80
    space = (data == 32) | ((data >= 9) & (data <= 13))
    hashes = chunk.word_hashes()
    first, grams = windows(hashes, bounds, 5)
    row = np.searchsorted(bounds, first, side="right") - 1
    twice = any_twin(mix64(grams + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.subtract.at(cover, first[twice] + 5, 1)
    repeated = np.cumsum(cover[:-1]) > 0
    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    line_end = np.concatenate([offsets[1:], breaks])
    line_start, line_end = np.sort(line_start, kind="stable"), np.sort(line_end, kind="stable")
    has_word = np.searchsorted(chunk.starts, line_end) > np.searchsorted(chunk.starts, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    line_key = mix64(chunk.span_hash(line_start, line_end) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return {
        "n_words": chunk.words_per_row,
        "word_chars": row_sums(starts_char & ~space, offsets),
        "n_symbols": row_sums(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_row[earlier_twin(line_key)], minlength=chunk.rows).astype(np.int64),
        "n_repeat_words": row_sums(repeated, bounds),
    }


def _gram_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Count of every bucket over all n-grams of all texts.

    Each task sends its vector in BUCKETS / CHUNK pieces; they are added up in two
    steps, so that even very many tasks make no large group.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                total += np.bincount(gram_buckets(data, offsets)[0], minlength=BUCKETS)
        pieces = total.reshape(-1, CHUNK)
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces)), pa.int32()), pa.array([salt] * len(pieces), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["chunk", "salt", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist())
        return rows.slice(0, 1).set_column(2, "counts", pa.array([total.tobytes()], pa.binary()))

    schema = "chunk int, salt int, counts binary"
    sums = docs.select(text).mapInArrow(count, schema).groupBy("chunk", "salt").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    out = np.zeros(BUCKETS)
    for chunk, _, counts in sums.collect():  # BUCKETS / CHUNK rows at most
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(bytes(counts), np.int64)
    return out


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """log p_target / p_raw of every bucket, over all rows of docs; trusted_ids: a column ``key``."""
    trusted = only(docs.select(key, text), trusted_ids, key)
    raw, target = _gram_counts(docs, text), _gram_counts(trusted, text)
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda x: (x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS)
    return np.log(share(target)) - np.log(share(raw))


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the five counts long, base_failed boolean, kept boolean, llr double) of every row."""
    docs = small_batches(docs)
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, trusted_ids, key, text))
    source = docs.select(F.col(key), F.col(text).alias("_text"))
    schema = schema_with(source.select(key), ", ".join(f"{name} long" for name in COUNTS) + ", base_failed boolean, kept boolean, llr double")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {name: [] for name in (*COUNTS, "llr")}
            for _, data, offsets in chunks(batch.column(1)):
                for name, values in text_counts(TextChunk(data, offsets)).items():
                    found[name].append(values)
                buckets, bounds = gram_buckets(data, offsets)
                found["llr"].append(row_sums(ratios.value[buckets], bounds) / np.maximum(np.diff(bounds), 1))
            got = {name: np.concatenate(v) if v else np.empty(0) for name, v in found.items()}
            failed = (got["n_words"] < LEAST_WORDS) | (100 * got["n_repeat_words"] > MOST_REPEATED * got["n_words"])
            score = np.round(got["llr"], 6)
            columns = [batch.column(0), *(pa.array(got[n].astype(np.int64)) for n in COUNTS), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(judge, schema)
