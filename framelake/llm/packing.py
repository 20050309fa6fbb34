"""Best-fit packing of tokenised documents by a configuration linear program.

1. Each task tokenises its texts, cuts those over CAPACITY and numbers its pieces
   within each length; token ids are not kept.
2. The length histogram (CAPACITY rows at most) reaches the driver, where the
   configuration program is solved by multiplicative weights: a knapsack dynamic
   program prices the best configuration, and the lengths it covers lose weight.
   Configurations are rounded down; what is left is packed best fit, many equal
   sequences at a time.
3. The result is a table of ranges (length, first ordinal, sequence, offset), whose
   size depends on the number of configurations only.  Every piece finds its place
   by its ordinal within its length.

Cases: a null or empty text is the end token alone; repeated rows are packed
each for itself; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import cut, schema_with, small_batches

CAPACITY, END_ID = 1024, 2
VOCABULARY = "byte_bpe_50k"
ROUNDS, EVERY, STEP, LONGER = 1000, 100, 2.0, 0.02


class TextTokenizer:
    """Ids of the tokenizers library for one vocabulary.

    Texts of Latin letters go through tiktoken, which holds the same vocabulary as
    ranks and gives the same ids faster; all others, and texts with the special
    token's string, go through tokenizers.
    """

    def __init__(self, tokenizer_path: str | None = None, ranks_path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        self.path, self.slow = tokenizer_path or public_tokenizers.path(f"{VOCABULARY}.json"), None
        with open(ranks_path or public_tokenizers.path(f"{VOCABULARY}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.unusual = re.compile("[^\x00-ɏ‐-›]")

    def ids(self, text: str) -> np.ndarray:
        if "<|" in text or self.unusual.search(text):
            if self.slow is None:  # loaded only where it is needed
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            found = self.slow.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        return np.array([*found, END_ID], "<u4")


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, length, capacity)]


def best_configuration(prices: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Unbounded knapsack: the multiset of lengths (index = length) of the highest total price within the capacity."""
    value = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        gains = value[room - 1 :: -1][:room] + prices[1 : room + 1]
        best = int(np.argmax(gains))
        if gains[best] > value[room - 1]:
            value[room], taken[room] = gains[best], best + 1
        else:
            value[room] = value[room - 1]
    out, room = np.zeros(capacity + 1, np.int64), capacity
    while room:
        if taken[room]:
            out[taken[room]] += 1
            room -= int(taken[room])
        else:
            room -= 1
    return out


def fractional(histogram: np.ndarray, rounds: int = ROUNDS, every: int = EVERY) -> Iterator[list[tuple[np.ndarray, float]]]:
    """Lists of (configuration, number of sequences), one each ``every`` rounds, by multiplicative weights.

    Every round takes the configuration of the highest price as often as its
    scarcest length allows; a length's weight falls with the share of its pieces
    that is covered.  Prices grow a little faster than lengths, so that of equal
    fillings the one with the longest pieces is taken.
    """
    size = np.arange(len(histogram)) / (len(histogram) - 1)
    here, need = histogram > 0, np.maximum(histogram, 1).astype(float)
    weights, covered = np.where(here, 1.0, 0.0), np.zeros(len(histogram))
    found: dict[bytes, list] = {}
    for done in range(1, (rounds if here.any() else 0) + 1):
        config = best_configuration(weights * size * (1 + LONGER * size), len(histogram) - 1)
        some = config > 0
        amount = float((need[some] / config[some]).min())
        found.setdefault(config.tobytes(), [config, 0.0])[1] += amount
        covered += amount * config / need
        weights = np.where(here, np.exp(-STEP * (covered - covered[here].min())), 0.0)
        weights = np.where(here, np.maximum(weights, 1e-9), 0.0)
        if done % every == 0:
            yield [(config, n) for config, n in found.values()]


def rounded(histogram: np.ndarray, solution: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, int]]:
    """Whole packing of a histogram: the solution rounded down, most used configurations first, and the rest best fit."""
    left, out = histogram.copy(), []
    for config, n in sorted(solution, key=lambda x: -x[1]):
        some = config > 0
        times = min(int(n), int((left[some] // config[some]).min()))
        if times:
            out.append((config, times))
            left -= times * config
    return out + best_fit(left)


def best_fit(histogram: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole packing of a histogram: the longest piece first, then always the longest that still fits."""
    left, out = histogram.copy(), []
    capacity = len(histogram) - 1
    while left.any():
        config, room = np.zeros_like(left), capacity
        while room:
            fits = np.flatnonzero(left[: room + 1] > config[: room + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            config[n] += min(int(left[n] - config[n]), room // n)
            room = capacity - int(config @ np.arange(capacity + 1))
        used = config > 0
        times = int((left[used] // config[used]).min())
        left -= times * config
        out.append((config, times))
    return out


def plan(histogram: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Ranges of ordinals sorted by (length, first): all pieces of a range go to successive sequences at one offset."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    full = int(left[-1])
    left[-1] = 0
    # Longer runs cover more with the program and leave less to best fit; which rounds best is known only afterwards.
    used = min((rounded(left, solution) for solution in fractional(left, rounds)), key=lambda u: sum(n for _, n in u), default=best_fit(left))
    if full:
        config = np.zeros_like(left)
        config[-1] = 1
        used.append((config, full))
    rows, ordinal, sequence = [], np.zeros(len(left), np.int64), 0
    for config, times in used:
        offset = 0
        for length in np.flatnonzero(config)[::-1].tolist():
            for _ in range(int(config[length])):
                rows.append((length, int(ordinal[length]), sequence, offset))
                ordinal[length] += times
                offset += length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32, task, rank): rank counts a task's pieces of one length."""
    source = small_batches(docs).select(F.col(key), F.col(text).alias("_text"))
    names = ["piece", "start", "length", "ids_crc32", "task", "rank"]
    schema = schema_with(source.select(key), "piece int, start long, length long, ids_crc32 long, task int, rank long")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task = TextTokenizer(tokenizer_path, ranks_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            owner = []
            for i, value in enumerate(batch.column(1)):
                ids = tokenizer.ids(value.as_py() or "")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    owner.append(i)
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for column, x in zip(rows, (piece, start, length, crc, task, int(seen[length]))):
                        column.append(x)
                    seen[length] += 1
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(rows, types))], names=[key, *names])

    return source.mapInArrow(cut_up, schema)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(key, piece int, start, length, ids_crc32, sequence_id, offset long) of every piece."""
    cut_pieces = cut(pieces(docs, key, text, capacity, tokenizer_path, ranks_path))
    by_task = cut(cut_pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():  # capacity rows at most
        histogram[length] = n
    ranges = docs.sparkSession.sparkContext.broadcast(plan(histogram))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    placed = cut_pieces.join(first, ["task", "length"]).select(key, "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("rank")).alias("_ordinal"))
    schema = schema_with(placed.drop("_ordinal"), "sequence_id long, offset long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranges.value
        span = np.int64(1) << np.int64(45)
        keys = table["length"] * span + table["first"]
        for batch in batches:
            ordinal = batch.column(5).to_numpy()
            at = np.searchsorted(keys, batch.column(3).to_numpy() * span + ordinal, side="right") - 1
            sequence = table["sequence"][at] + ordinal - table["first"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(table["offset"][at])], names=schema.names)

    return placed.mapInArrow(place, schema)
