"""Quality classifier: logistic regression over hashed word n-grams.

Words here are runs of letters and digits or runs of other non-space characters,
so a symbol glued to a word is a word of its own.  A document's features are its
words and pairs of neighbouring words, hashed into BUCKETS slots and divided by
their number; a score is the sigmoid of a sparse dot product.  Weights are learnt
with follow-the-regularised-leader (proximal) updates in one task, on a sample of
labelled rows bounded by ``most_rows`` and chosen by a hash of doc_id; weights,
BUCKETS numbers at most, are the only thing that travels.

Cases: a null or empty text has no features and scores the bias; a doc_id with
several labels counts once, with the lowest; unlabelled or empty inputs give the
score 0.5; repeated rows give repeated scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import schema_with, small_batches
from .kernels import TextChunk, chunks, mix64, row_sums

BUCKETS = 1 << 18
#: Labelled rows to learn from, on average at most; more labels than that are sampled.
MOST_ROWS, EPOCHS = 8000, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-2, 1e-3
#: Features are shares of a document's n-grams, scaled so that steps are of a usual size.
SCALE = 100.0
CUTOFF = 0.3
_KIND = np.ones(256, np.int8)  # letters, digits and all beyond ASCII
_KIND[:128] = [1 if chr(i).isalnum() else 2 for i in range(128)]
_KIND[[0x20, *range(0x09, 0x0E)]] = 0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, row bounds)."""
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    chunk = TextChunk(data, offsets)
    hashes = chunk.span_hash(starts, ends)
    bounds = np.searchsorted(starts, offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.empty(0, np.int64)
    pairs = mix64(hashes[pair] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[pair + 1])
    rows = np.concatenate([row, row[pair]])
    order = np.argsort(rows, kind="stable")
    buckets = (np.concatenate([hashes, pairs])[order] >> np.uint64(64 - 18)).astype(np.int64)
    return buckets, np.searchsorted(rows[order], np.arange(len(offsets)))


class FollowTheRegularisedLeader:
    """Proximal updates; slot BUCKETS is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def _sparse(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(buckets, return_counts=True)
    return np.append(at, BUCKETS), np.append(SCALE * n / max(len(buckets), 1), 1.0)


def fit(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Weights from (buckets, label), in the order given."""
    model = FollowTheRegularisedLeader()
    ready = [(*_sparse(buckets), label) for buckets, label in rows]
    for _ in range(EPOCHS):
        for at, values, label in ready:
            model.learn(at, values, label)
    return model.weights()


def scores(weights: np.ndarray, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    margin = SCALE * row_sums(weights[buckets], bounds) / np.maximum(np.diff(bounds), 1) + weights[BUCKETS]
    return np.round(1 / (1 + np.exp(-np.clip(margin, -35, 35))), 6)


def train(docs: DataFrame, labels: DataFrame, label: str, most_rows: int = MOST_ROWS, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights learnt from the labelled rows, or a hash sample of about most_rows of them."""
    labels = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("_label"))
    share = min(1.0, most_rows / max(1, labels.count()))
    order = F.xxhash64(F.col(key), F.lit("order"))
    few = labels.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)))  # about most_rows rows, so broadcast is bounded
    chosen = small_batches(docs).select(key, text).join(F.broadcast(few), key).select("_label", F.col(text), order.alias("_order"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                buckets, bounds = features(data, offsets)
                raw = [buckets[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raw)), pa.array(raw, pa.binary()), batch.column(2).slice(first, len(raw))], names=["label", "buckets", "order"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("label", "ascending"), ("buckets", "ascending")])
        weights = fit([(np.frombuffer(b, np.int32).astype(np.int64), y) for b, y in zip(table.column("buckets").to_pylist(), table.column("label").to_pylist())])
        at = np.flatnonzero(weights)
        return pa.table({"slot": pa.array(at, pa.int32()), "weight": pa.array(weights[at])})

    rows = chosen.mapInArrow(extract, "label int, buckets binary, order long").groupBy(F.lit("all").alias("one")).applyInArrow(learn, "slot int, weight double")
    out = np.zeros(BUCKETS + 1)
    for slot, weight in rows.collect():  # BUCKETS + 1 rows at most
        out[slot] = weight
    return out


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score double) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    source = small_batches(docs).select(F.col(key), F.col(text).alias("_text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scores(shared.value, *features(data, offsets)) for _, data, offsets in chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got) if got else np.empty(0))], names=[key, "score"])

    return source.mapInArrow(apply, schema_with(source.select(key), "score double"))


def held_out(key: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def quality_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out boolean, score double, predicted int) of every row."""
    weights = train(docs, labels.where(~held_out(F.col(key))), label, key=key, text=text)
    return score(docs, weights, key, text).select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
