"""Secret scans of whole texts through a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams.
Each task reads its texts in segments, posts the queries' trigrams, intersects
the postings and runs the expression on the candidates only.  A rule whose
expression has no mandatory trigram (a run of hex digits) scans every text.
Segments are local to a task: there is no shuffle, a key cannot be hot, and a lost
executor costs only its own tasks again.

Cases: a null or empty text has no spans; a very long text is a segment of its
own; repeated rows give repeated results; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with, small_batches
from .kernels import chunks
from .trigram import Segment, query_of, trigrams_of


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose group has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Well-known public token formats; they only add spans.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "struct<kind:string,start:long,end:long>"


def spans_of(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """Brute force: every rule over the text."""
    found = [(m.start(), i, m.end()) for i, r in enumerate(rules) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
    return [(rules[i].kind, start, end) for start, i, end in sorted(found)]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<kind, start, end>>) of every row; offsets are code points, end exclusive."""
    queries = [query_of(r.pattern) for r in rules]
    vocabulary = sorted(set().union(*map(trigrams_of, queries)))
    kinds = [r.kind for r in rules]
    source = small_batches(docs).select(F.col(key), F.col(text).alias("_text"))
    schema = schema_with(source.select(key), f"spans array<{SPAN}>")
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for first, data, offsets in chunks(batch.column(1)):
                segment = Segment(data, offsets, vocabulary)
                raw = data.tobytes()
                decoded: dict[int, str] = {}
                for i, (rule, query) in enumerate(zip(rules, queries)):
                    rows = segment.rows(query)
                    for row in range(len(offsets) - 1) if rows is None else rows.tolist():
                        if row not in decoded:
                            decoded[row] = raw[offsets[row] : offsets[row + 1]].decode()
                        for m in compiled[i].finditer(decoded[row]):
                            if len(m[rule.group]) >= rule.least:
                                out[first + row].append((m.start(), i, m.end()))
            spans = [[{"kind": kinds[i], "start": s, "end": e} for s, i, e in sorted(found)] for found in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span_type)], names=[key, "spans"])

    return source.mapInArrow(scan, schema)
