"""Exact deduplication with counting quotient filters.

1. One pass over the texts gives each row a SHA-256 of its normalised text and a
   64-bit fingerprint (the first 64 bits); only these are kept.
2. Each task builds counting quotient filters of its fingerprints, cut into blocks
   by their high bits.  The filters of a block merge losslessly by their sorted
   remainders.  A text that a third of all rows share is one entry in each filter.
3. Texts whose fingerprint counts above one go on to byte verification: a second
   pass passes only rows whose fingerprint is in a bitmap sized by the number of
   repeated fingerprints (beyond a bound one pass for each of a few ranges of them,
   beyond those one pass without a bitmap) and groups them by the text's bytes, with
   partial aggregation before the shuffle; only groups of repeated fingerprints stay.
4. Results join back to the rows by fingerprint and digest; the fewer than 1,000
   possible hot groups by broadcast, the others by shuffle.

Cases: a null text is an empty one and equals other empty texts; whitespace runs
become one space and are not trimmed; doc_id identifies a row, so repeated rows
of one doc_id get equal results; a null doc_id never becomes a group's keep_id
unless it has no other, and then the row is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Members, cut, join_with_hot_keys
from .cqf import CountingQuotientFilter

#: Fingerprints that a task gathers before it closes a filter, and those meant for a merge block.
FILTER_ENTRIES, BLOCK_ENTRIES = 1 << 20, 1 << 14


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _fingerprint(digest: Column) -> Column:
    """The digest's first 64 bits as a long."""
    high, low = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def repeated_fingerprints(rows: DataFrame, column: str, total: int) -> DataFrame:
    """(fingerprint, n) of the fingerprints that ``rows`` has more than once."""
    bits = min(20, max(4, (total // BLOCK_ENTRIES).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filters(found: CountingQuotientFilter) -> Iterator[pa.RecordBatch]:
            keys, counts = found.entries()
            block = (keys >> np.uint64(64 - bits)).astype(np.int64)
            bounds = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(keys) else []
            parts = [(int(block[a]), CountingQuotientFilter.of_sorted(keys[a:b] << np.uint64(bits), counts[a:b]).to_bytes()) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["block", "filter"])

        waiting: list[CountingQuotientFilter] = []
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            waiting.append(CountingQuotientFilter.of(values))
            if sum(len(f.remainders) for f in waiting) > FILTER_ENTRIES:
                yield from filters(CountingQuotientFilter.merge(waiting))
                waiting = []
        if waiting:
            yield from filters(CountingQuotientFilter.merge(waiting))

    def merge(block: tuple, table: pa.Table) -> pa.Table:
        keys, counts = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("filter")]).entries()
        more = counts > 1
        keys = keys[more] >> np.uint64(bits) | np.uint64(block[0].as_py()) << np.uint64(64 - bits)
        return pa.table({"fingerprint": keys.view(np.int64), "n": counts[more]})

    return rows.select(column).mapInArrow(build, "block int, filter binary").groupBy("block").applyInArrow(merge, "fingerprint long, n long")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size long, kept boolean, text_sha256) of every row."""
    plain = docs.select(F.col(key).alias("_id"), normalised(F.col(text)).alias("_text"))
    marked = plain.withColumn("_sha", F.sha2("_text", 256)).withColumn("_print", _fingerprint(F.col("_sha")))
    prints = cut(marked.select("_id", "_sha", "_print"))
    total = prints.count()
    repeated = cut(repeated_fingerprints(prints, "_print", total))
    routed = Members(repeated, "fingerprint").possibly(marked, "_print")
    by_bytes = routed.groupBy("_print", "_text").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(
        by_bytes.where(F.col("group_size") > 1)
        .join(repeated.select(F.col("fingerprint").alias("_print")), "_print")
        .select("_print", F.sha2("_text", 256).alias("_sha"), "keep_id", "group_size")
    )
    joined = join_with_hot_keys(prints, groups, ["_print", "_sha"], "group_size", total)
    return joined.select(
        F.col("_id").alias(key),
        F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
