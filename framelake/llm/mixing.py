"""Mixing sources to target weights by hash-threshold histograms.

A source's target is its weighted share of all tokens, limited to ``most`` times
its own tokens; what goes beyond is shared anew by weight (water filling, by a few
sums over the sources).  Every document is taken floor(target / size)
times.  The rest of the budget is met by a threshold on a hash of doc_id: tokens
are summed by source and hash bucket, the bucket in which the budget runs out is
found, and only that bucket is refined by the next DIGIT bits, until it holds one
hash value.  A few further passes spend what the boundary document left over on
smaller documents.  No document is sorted; a hot source is a few thousand sums.

Cases: a null or empty text has size 0 and takes nothing; null sources form one
source, last in order; rows with equal ids are taken or left together; a null
doc_id hashes as an empty one; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hex_mask

DIGIT, DIGITS = 12, 5
PASSES = 3
WEIGHTS, MOST = (1, 2, 3), 3
#: A per-source table of more rows is not broadcast but spread over SALTS copies.
MOST_BROADCAST, SALTS = 100_000, 64
#: Ranges of sources that are numbered apart.
RANGES = 32


def with_source(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """rows joined with a table that has one row a source number."""
    if few:
        return rows.join(F.broadcast(table), "_s")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod("_hash", F.lit(SALTS)).cast("int")).join(salted, ["_s", "_salt"]).drop("_salt")


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with _rank, the source's place by code point from 0, null last.

    Sources are dealt to ranges, counted by range and numbered within each; at most
    RANGES counts meet in one task.
    """
    order = F.col("source").asc_nulls_last()
    dealt = cut(sizes.repartitionByRange(RANGES, order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return dealt.withColumn("_in", within).join(F.broadcast(firsts), "_range").withColumn("_rank", F.col("_first") + F.col("_in")).drop("_range", "_first", "_in")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target double, _rank) from (source, source_size): one row a source.

    The water level rises from the plain share: each round takes out the sources that
    it covers and shares their excess, by two sums over the sources, until none follows.
    """
    exact = lambda c: c.cast("decimal(38,0)")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    rows = cut(_ranked(sizes).withColumns({"_w": exact(weight), "_z": exact(F.col("source_size"))}))
    total = lambda df: [int(x or 0) for x in df.agg(F.sum("_z"), F.sum("_w")).first()]
    everything, all_weights = total(rows)
    full, full_weights = 0, 0
    while True:
        rest, free = everything - most * full, all_weights - full_weights
        number = lambda x: exact(F.lit(str(x)))
        capped = most * F.col("_z") * number(free) <= F.col("_w") * number(rest)
        now = total(rows.where(capped))
        if free == 0 or now == [full, full_weights]:
            break
        full, full_weights = now
    shared = (F.col("_w") * number(rest)).cast("double") / number(max(free, 1)).cast("double")
    return rows.select("source", "source_size", F.when(capped, (most * F.col("_z")).cast("double")).otherwise(shared).alias("target"), "_rank")


def _thresholds(items: DataFrame, budgets: DataFrame, few: bool) -> DataFrame:
    """(_s, _limit, spent): the highest limit such that items of a source with a hash below it fit its budget."""
    state = budgets.select("_s", "budget", F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("decimal(38,0)").alias("spent"))
    inside = items
    for digit in range(DIGITS):
        shift = DIGIT * (DIGITS - 1 - digit)
        inside = with_source(inside, state.select("_s", "_prefix"), few).where(F.shiftright("_hash", shift + DIGIT) == F.col("_prefix")).drop("_prefix")
        sums = inside.groupBy("_s", F.shiftright("_hash", shift).alias("_bucket")).agg(F.sum("_size").cast("decimal(38,0)").alias("n"), F.min("_hash").alias("_lo"), F.max("_hash").alias("_hi"))
        up_to = F.sum("n").over(Window.partitionBy("_s").orderBy("_bucket"))
        edge = sums.join(state.select("_s", "budget", "spent"), "_s").withColumn("up_to", F.col("spent") + up_to).where(F.col("up_to") > F.col("budget"))
        edge = edge.groupBy("_s").agg(F.min_by(F.struct("_bucket", F.col("up_to") - F.col("n"), "_lo", "_hi"), "_bucket").alias("e"))
        below = inside.groupBy("_s").agg(F.sum("_size").cast("decimal(38,0)").alias("n"))
        state = cut(
            state.join(edge, "_s", "left")
            .join(below, "_s", "left")
            .select(
                "_s",
                "budget",
                F.coalesce("e._bucket", (F.col("_prefix") + 1) * (1 << DIGIT)).alias("_prefix"),
                F.coalesce(F.col("e.col2"), F.col("spent") + F.coalesce("n", F.lit(0))).cast("decimal(38,0)").alias("spent"),
                F.coalesce(F.col("e._lo") < F.col("e._hi"), F.lit(False)).alias("_open"),
            )
        )
        if digit + 1 == DIGITS or not state.where("_open").limit(1).count():
            return state.select("_s", F.shiftleft("_prefix", shift).alias("_limit"), "spent")
    raise AssertionError


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> list:
    """Columns _source, _size (the number of words) and _hash (60 bits of a digest of the id)."""
    words = F.coalesce(F.regexp_count(docs[text], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    hashed = hex_mask(F.md5(F.coalesce(docs[key].cast("string"), F.lit("")).cast("binary")), 15)
    return [docs[source].alias("_source"), words.alias("_size"), hashed.alias("_hash")]


class Mixture:
    """Thresholds fitted to all rows; repeats() then decides on any row by itself."""

    def __init__(self, items: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST):
        """items: _source, _size, _hash of every row, read several times."""
        sizes = items.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
        # Sources are numbered, so that later joins need no null-safe keys.
        aims = targets(sizes, weights, most).withColumnRenamed("_rank", "_s")
        times = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
        aims = aims.withColumn("_times", times.cast("int"))
        rest = F.when(F.col("_times") < most, F.floor(F.col("target") - F.col("_times") * F.col("source_size"))).otherwise(0)
        self.aims = cut(aims.withColumn("budget", rest.cast("decimal(38,0)")))
        self.few = self.aims.count() <= MOST_BROADCAST
        rows = self._numbered(items)
        left, budgets, limits = rows, self.aims.select("_s", "budget"), None
        for step in range(PASSES):
            found = _thresholds(left, budgets, self.few)
            room = (F.col("budget") - F.col("spent")).cast("decimal(38,0)").alias(f"_room{step}")
            passed = found.join(budgets, "_s").select("_s", F.col("_limit").alias(f"_limit{step}"), room)
            limits = cut(passed if limits is None else limits.join(passed, "_s"))
            budgets = limits.select("_s", F.col(f"_room{step}").alias("budget"))
            left = with_source(rows, limits, self.few).where(~self._extra(step) & (F.col("_size") <= F.col(f"_room{step}")) & (F.col("_size") > 0)).select("_s", "_size", "_hash")
        self.limits = limits

    @staticmethod
    def _extra(last: int):
        """Whether a row is taken once more, by the passes up to ``last``."""
        out = F.col("_hash") < F.col("_limit0")
        for step in range(1, last + 1):
            out = out | ((F.col("_size") <= F.col(f"_room{step - 1}")) & (F.col("_hash") < F.col(f"_limit{step}")))
        return out

    def _numbered(self, rows: DataFrame) -> DataFrame:
        names = self.aims.select("_s", F.col("source").alias("_name"))
        if self.few:
            return rows.join(F.broadcast(names), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
        salted = names.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod("_hash", F.lit(SALTS)).cast("int"))
        return rows.join(salted, (F.col("_salt") == F.col("_copy")) & F.col("_source").eqNullSafe(F.col("_name"))).drop("_name", "_salt", "_copy")

    def repeats(self, rows: DataFrame) -> DataFrame:
        """rows (with _source, _size, _hash) and source_size, target, _repeats int."""
        table = self.limits.join(self.aims.select("_s", "source_size", "target", "_times"), "_s")
        taken = F.when(F.col("_size") > 0, F.col("_times") + self._extra(PASSES - 1).cast("int")).otherwise(0).cast("int")
        fields = [f"_{n}{i}" for i in range(PASSES) for n in ("limit", "room")]
        return with_source(self._numbered(rows), table, self.few).withColumn("_repeats", taken).drop("_s", "_times", *fields)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size long, source_size long, target double, taken long, source, repeats int) of every row."""
    items = cut(docs.select(docs[key].alias("_id"), *measured(docs, key, text, source)))
    final = Mixture(items, weights, most).repeats(items)
    taken = (F.col("_size") * F.col("_repeats")).cast("long").alias("taken")
    return final.select(F.col("_id").alias(key), F.col("_size").alias("size"), "source_size", "target", taken, F.col("_source").alias("source"), F.col("_repeats").alias("repeats"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs, each row as often as the mixture takes it; texts are filtered where they are read, not shuffled."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *measured(docs, key, text, source))
    mixture = Mixture(cut(rows.select("_source", "_size", "_hash")), weights, most)
    return mixture.repeats(rows).where("_repeats > 0").select("_row", F.explode(F.sequence(F.lit(1), "_repeats"))).select("_row.*")
