"""Vectorised byte kernels shared by the Python-side text operators.

A :class:`TextChunk` is a run of whole texts laid end to end as UTF-8 bytes.
Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; as separators are
ASCII, byte boundaries are code point boundaries.  All hashes are 64 bits: a
polynomial over per-byte random values, finished by an avalanche mix, computed
for every word of the chunk at once from one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser: a bijection of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(_MULT) + U64(seed))


_BYTE_VALUE = seeded(256, 77)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    key = f"{base}"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, U64)
        out[0] = 1
        done = 1
        while done < size:  # doubling: p[k + i] = p[k] * p[i]
            step = min(done, size - done)
            out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
            done += step
        _POWERS[key] = have = out
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class TextChunk:
    """Words of a few whole texts: byte spans, owning row, 64-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        self.hashed = _LOWER[data] if lower else data
        inside = ~_IS_SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:-1]
        ends = inside
        ends[:-1] &= ~np.concatenate([inside[1:]]) | first[1:-1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self._sums: np.ndarray | None = None

    @property
    def word_row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.words_per_row)

    @property
    def word_bounds(self) -> np.ndarray:
        """rows + 1 indices into the words."""
        return np.searchsorted(self.starts, self.offsets)

    @property
    def words_per_row(self) -> np.ndarray:
        return np.diff(self.word_bounds)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte span; equal bytes have equal hashes."""
        n = len(self.data)
        if self._sums is None:
            self._sums = np.zeros(n + 1, U64)
            np.cumsum(_BYTE_VALUE[self.hashed] * _powers(_MULT, n), out=self._sums[1:])
        raw = (self._sums[ends] - self._sums[starts]) * _powers(_INVERSE, n + 1)[starts]
        return mix64(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def word_hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)


def chunks(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; a longer text is a run of its own."""
    data, offsets = text_buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``width`` words inside one row."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, U64)
    ok = np.ones(n, bool)
    for end in range(1, width):  # the last width - 1 words of each row start none
        last = bounds[1:] - end
        ok[last[last >= bounds[:-1]]] = False
    first = np.flatnonzero(ok)
    out = np.zeros(len(first), U64)
    for i in range(width):
        out = out * U64(0xC2B2AE3D27D4EB4F) + hashes[first + i]
    return first, mix64(out)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each row; empty rows give 0."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def earlier_twin(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = True
    return out


def any_twin(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands elsewhere."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out
