"""Counting quotient filter over 64-bit fingerprints, built in bulk.

A fingerprint splits into a quotient (its high bits) and a remainder (the rest).
Remainders stand sorted in one run per quotient; ``occupied`` marks the quotients
that have a run and ``run_ends`` the last slot of each run, so (quotient,
remainder, count) can be read back without loss.  Two filters merge by merging
their sorted remainders and adding the counts of equal ones.
"""

from __future__ import annotations

import numpy as np


class CountingQuotientFilter:
    def __init__(self, quotient_bits: int, occupied: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotient_bits, self.occupied, self.run_ends, self.remainders, self.counts = quotient_bits, occupied, run_ends, remainders, counts

    @classmethod
    def of_sorted(cls, fingerprints: np.ndarray, counts: np.ndarray, quotient_bits: int | None = None) -> CountingQuotientFilter:
        """From distinct fingerprints in ascending order."""
        n = len(fingerprints)
        bits = quotient_bits or max(3, int(n).bit_length())
        quotients = (fingerprints >> np.uint64(64 - bits)).astype(np.int64)
        present = np.zeros(1 << bits, bool)
        present[quotients] = True
        ends = np.ones(n, bool)
        ends[:-1] = quotients[1:] != quotients[:-1]
        return cls(bits, np.packbits(present), np.packbits(ends), fingerprints & np.uint64((1 << (64 - bits)) - 1), counts.astype(np.int64))

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        return cls.of_sorted(*np.unique(fingerprints, return_counts=True))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints ascending, counts)."""
        n = len(self.remainders)
        ends = np.flatnonzero(np.unpackbits(self.run_ends)[:n])
        quotients = np.flatnonzero(np.unpackbits(self.occupied)).astype(np.uint64)
        lengths = np.diff(np.concatenate([[-1], ends]))
        return np.repeat(quotients, lengths) << np.uint64(64 - self.quotient_bits) | self.remainders, self.counts

    @staticmethod
    def merge(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        parts = [f.entries() for f in filters] or [(np.empty(0, np.uint64), np.empty(0, np.int64))]
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(first)
        return CountingQuotientFilter.of_sorted(keys[at], np.add.reduceat(counts, at) if len(at) else counts)

    def to_bytes(self) -> bytes:
        """Header, bit vectors, remainders in as few bytes as their bits need, counts in 1 or 8 bytes."""
        n, width = len(self.remainders), -(-(64 - self.quotient_bits) // 8)
        wide = bool(n) and int(self.counts.max()) > 255
        remainders = self.remainders.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        head = np.array([self.quotient_bits, n, wide], "<i8")
        return b"".join([head.tobytes(), self.occupied.tobytes(), self.run_ends.tobytes(), remainders.tobytes(), self.counts.astype("<i8" if wide else np.uint8).tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        bits, n, wide = np.frombuffer(raw, "<i8", 3).tolist()
        at, width = 24, -(-(64 - bits) // 8)
        occupied = np.frombuffer(raw, np.uint8, (1 << bits) // 8, at)
        at += len(occupied)
        ends = np.frombuffer(raw, np.uint8, -(-n // 8), at)
        at += len(ends)
        padded = np.zeros((n, 8), np.uint8)
        padded[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        counts = np.frombuffer(raw, "<i8" if wide else np.uint8, n, at).astype(np.int64)
        return cls(bits, occupied, ends, padded.view("<u8").reshape(n).astype(np.uint64), counts)
