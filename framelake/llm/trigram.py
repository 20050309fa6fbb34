"""Trigram inverted index over segments of whole texts, and Boolean trigram queries.

A query is True (every text may match) or a nested tuple ("and" | "or", parts)
whose leaves are 3-byte strings.  Queries and index fold A-Z to a-z, so they hold
for patterns of either case; a query never leaves out a text that matches.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np

_parser, _codes = re._parser, re._constants
#: Alternatives kept apart before a literal part is closed.
MOST_STRINGS = 64


def _all_of(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _needs(strings: set[bytes]) -> object:
    """The query of a part that is one of the strings."""
    return _any_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _members(items: list) -> set[bytes] | None:
    """The few characters of a class, or None."""
    out: set[bytes] = set()
    for op, value in items:
        if op is _codes.LITERAL:
            out.add(chr(value).encode().lower())
        elif op is _codes.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).encode().lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(sequence) -> tuple[set[bytes] | None, object]:
    """(all strings of a sequence if few, the query it implies)."""
    open_strings: set[bytes] = {b""}
    needed: list = []
    whole = True

    def close() -> None:
        nonlocal open_strings, whole
        needed.append(_needs(open_strings))
        open_strings, whole = {b""}, False

    for op, value in sequence:
        strings: set[bytes] | None = None
        query: object = True
        if op is _codes.LITERAL:
            strings = {chr(value).encode().lower()}
        elif op is _codes.IN:
            strings = _members(value)
        elif op is _codes.AT:
            strings = {b""}
        elif op is _codes.SUBPATTERN:
            strings, query = _walk(value[3])
        elif op is _codes.BRANCH:
            branches = [_walk(b) for b in value[1]]
            strings = None if any(s is None for s, _ in branches) else set().union(*(s for s, _ in branches))
            query = _any_of([q for _, q in branches])
        elif op in (_codes.MAX_REPEAT, _codes.MIN_REPEAT, _codes.POSSESSIVE_REPEAT):
            least, most, inner = value
            inner_strings, inner_query = _walk(inner)
            if inner_strings is not None and most == 1:
                strings = inner_strings | ({b""} if least == 0 else set())
            elif inner_strings is not None and least == most and least <= 8:
                strings = reduce(lambda a, _: {x + y for x in a for y in inner_strings}, range(least), {b""}) if len(inner_strings) ** least <= MOST_STRINGS else None
            if strings is None and least > 0:
                query = inner_query
        if strings is not None and len(strings) * len(open_strings) <= MOST_STRINGS:
            open_strings = {a + b for a in open_strings for b in strings}
        else:
            close()
            needed.append(query if strings is None else _needs(strings))
    if not whole:
        close()
        return None, _all_of(needed)
    return open_strings, _needs(open_strings)


def query_of(pattern: str) -> object:
    """The Boolean trigram query that every text with a match satisfies."""
    return _walk(_parser.parse(pattern))[1]


def trigrams_of(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class Segment:
    """Postings (sorted row numbers) of the vocabulary's trigrams in a run of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, vocabulary: list[bytes]):
        self.postings = {t: np.empty(0, np.int64) for t in vocabulary}
        if len(data) < 3 or not vocabulary:
            return
        upper = (data >= 65) & (data <= 90)
        folded = data + upper.astype(np.uint8) * np.uint8(32)
        code = folded[:-2].astype(np.int32)
        code <<= 8
        code |= folded[1:-1]
        code <<= 8
        code |= folded[2:]
        term = np.zeros(1 << 24, np.uint8 if len(vocabulary) < 255 else np.int32) if Segment._table is None or Segment._table[0] != vocabulary else Segment._table[1]
        if Segment._table is None or Segment._table[0] != vocabulary:
            for i, t in enumerate(vocabulary, 1):
                term[int.from_bytes(t, "big")] = i
            Segment._table = (vocabulary, term)
        found = term[code]
        at = np.flatnonzero(found)
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[row + 1]
        pairs = np.unique(found[at[inside]].astype(np.int64) * len(offsets) + row[inside])
        terms = pairs // len(offsets)
        bounds = np.searchsorted(terms, np.arange(1, len(vocabulary) + 2))
        for i, t in enumerate(vocabulary):
            self.postings[t] = pairs[bounds[i] : bounds[i + 1]] % len(offsets)

    _table: tuple | None = None

    def rows(self, query: object) -> np.ndarray | None:
        """Rows that satisfy the query, or None for all: postings are intersected shortest first."""
        if query is True:
            return None
        if isinstance(query, bytes):
            return self.postings[query]
        parts = [r for r in map(self.rows, query[1]) if r is not None]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True) if len(a) else a, sorted(parts, key=len))
