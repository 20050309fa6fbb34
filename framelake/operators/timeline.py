"""Order-aware operators on one time axis: as-of pacing, running sums, sessions, unwrapping, seeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocked


def running(by: str | list[str], *order: str):
    """Rows from the start of a partition to the current one."""
    by = [by] if isinstance(by, str) else by
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def as_of(left: DataFrame, right: DataFrame, by: str, t: str, value: str, slack: int = 0) -> DataFrame:
    """left with the latest right value whose t is at most left.t + slack, per ``by``: one union and one window."""
    l = left.select(by, F.col(t).alias("_t"), (F.col(t) + slack).alias("_at"), *[c for c in left.columns if c not in (by, t)], F.lit(1).alias("_side"))
    r = right.select(by, F.col(t).alias("_at"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    seen = Window.partitionBy(by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = l.unionByName(r, allowMissingColumns=True).withColumn("_found", F.last("_v", ignorenulls=True).over(seen))
    return merged.where("_side = 1").select(by, F.col("_t").alias(t), *[c for c in left.columns if c not in (by, t)], F.col("_found").alias(value))


def late_rows(rows: DataFrame, by: str, order: str, t: str, allowed: int, width: float = blocked.ORDINALS) -> DataFrame:
    """Adds late: older than the running maximum of earlier arrivals by more than ``allowed``."""
    seen = blocked.running(rows, by, order, width, _latest=("max_before", F.col(t)))
    return seen.withColumn("late", F.coalesce(F.col(t) + allowed < F.col("_latest"), F.lit(False))).drop("_latest")


def sessions(rows: DataFrame, by: str, t: str, gap: int, tie: str) -> DataFrame:
    """Adds session (from 1): a new one starts after a pause longer than gap."""
    w = Window.partitionBy(by).orderBy(t, tie)
    fresh = F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(True)).cast("int")
    return rows.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(running(by, t, tie)).cast("long")).drop("_fresh")


def change_runs(rows: DataFrame, by: str, order: str, key: Column) -> DataFrame:
    """Adds run (from 1): a number that grows when the key differs from the row before."""
    w = Window.partitionBy(by).orderBy(order)
    rows = rows.withColumn("_key", key)
    changed = (~F.col("_key").eqNullSafe(F.lag("_key").over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(running(by, order)).cast("long")).drop("_changed", "_key")


def unwrap(rows: DataFrame, by: str, order: str | list[str], t: str, bits: int = 33, width: float = blocked.ORDINALS) -> DataFrame:
    """Adds unwrapped: t made monotone over wraps of a counter of so many bits."""
    rows = blocked.running(rows, by, order, width, _last=("lag", F.col(t)))
    step = F.col(t) - F.col("_last")
    wrap = F.when(step < -(1 << (bits - 1)), F.lit(1 << bits)).when(step > (1 << (bits - 1)), F.lit(-(1 << bits))).otherwise(F.lit(0)).cast("long")
    wraps = blocked.running(rows.withColumn("_wrap", wrap).drop("_last"), by, order, width, _wraps=("sum", F.col("_wrap")))
    return wraps.withColumn("unwrapped", F.col(t) + F.col("_wraps")).drop("_wrap", "_wraps")


def seek_epochs(rows: DataFrame, by: str, order: str, request: Column, answer: Column, width: float = blocked.ORDINALS) -> DataFrame:
    """Batch form of the seek state machine: adds pending and epoch.

    Rows from a request (generation) up to the barrier that answers the latest
    request are pending and would be discarded; each answered request starts an epoch.
    """
    rows = blocked.running(rows.withColumn("_request", request).withColumn("_answer", answer), by, order, width, _asked=("max", F.col("_request")))
    rows = blocked.running(rows, by, order, width, _answered=("max", F.when(F.col("_answer") == F.col("_asked"), F.col("_answer"))))
    pending = F.coalesce(F.col("_asked") > F.coalesce(F.col("_answered"), F.lit(-1)), F.lit(False))
    return rows.withColumn("pending", pending).withColumn("epoch", F.coalesce("_answered", F.lit(0)).cast("long")).drop("_request", "_answer", "_asked", "_answered")


def interpolate(rows: DataFrame, by: str, t: str, value: str, tie: str, kind: str = "linear", tangents: tuple[str, str] | None = None) -> DataFrame:
    """Fills null values between the known ones around them; holds the ends.

    step keeps the one before, linear draws a line, cubic takes the slopes on either
    side from the tangents (into and out of a key, per unit of t).
    """
    if kind not in ("step", "linear", "cubic") or (kind == "cubic") != (tangents is not None):
        raise ValueError(f"interpolation {kind} with tangents {tangents}")
    back = running(by, t, tie)
    ahead = Window.partitionBy(by).orderBy(F.desc_nulls_last(t), F.desc_nulls_last(tie)).rowsBetween(Window.unboundedPreceding, 0)  # a frame that ends at the last row costs its length for every row
    known = F.when(F.col(value).isNotNull(), F.col(t))
    a, b = F.last(value, ignorenulls=True).over(back), F.last(value, ignorenulls=True).over(ahead)
    ta, tb = F.last(known, ignorenulls=True).over(back), F.last(known, ignorenulls=True).over(ahead)
    rows = rows.withColumns({"_a": a, "_b": b, "_ta": ta, "_tb": tb})
    if kind == "step":
        return rows.withColumn(value, F.coalesce(value, "_a", "_b")).drop("_a", "_b", "_ta", "_tb")
    if kind == "cubic":
        into, out_of = tangents
        known_in, known_out = (F.when(known.isNotNull(), F.col(c)) for c in tangents)
        rows = rows.withColumns({"_ma": F.last(known_out, ignorenulls=True).over(back), "_mb": F.last(known_in, ignorenulls=True).over(ahead)})
        span = F.nullif(F.col("_tb") - F.col("_ta"), F.lit(0))
        s = (F.col(t) - F.col("_ta")) / span
        curve = (2 * s * s * s - 3 * s * s + 1) * F.col("_a") + (s * s * s - 2 * s * s + s) * span * F.col("_ma") + (3 * s * s - 2 * s * s * s) * F.col("_b") + (s * s * s - s * s) * span * F.col("_mb")
        return rows.withColumn(value, F.coalesce(value, curve, "_a", "_b")).drop("_a", "_b", "_ta", "_tb", "_ma", "_mb")
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col(t) - F.col("_ta")) / F.nullif(F.col("_tb") - F.col("_ta"), F.lit(0))
    return rows.withColumn(value, F.coalesce(value, line, "_a", "_b")).drop("_a", "_b", "_ta", "_tb")


#: Steps of one stream that fill_gaps gives in one go.
RUN = 1440


def fill_gaps(rows: DataFrame, by: str, t: str, step: int, run: int = RUN) -> DataFrame:
    """Rows every ``step`` between those of a stream, with concealed set on the added ones.

    A gap is cut at the multiples of ``run`` steps, and within a partition the streams
    take turns from one multiple to the next.  So the same few times come again and again, and
    rows that are nearly all times are stored in a fraction of their size; only the cut gaps are sorted.
    """
    w, span = Window.partitionBy(by).orderBy(t), run * step
    last = F.greatest(F.coalesce(F.lead(t).over(w), F.col(t) + step) - 1, F.col(t))
    gaps = rows.withColumn("_until", last).withColumn("_until", F.col("_until") - F.pmod(F.col("_until") - F.col(t), F.lit(step)))
    cut = gaps.withColumn("_run", F.explode(F.sequence(*(F.floor(F.col(c) / span) for c in (t, "_until"))))).sortWithinPartitions("_run", by, t)
    start = F.col("_run") * span
    start = F.greatest(F.col(t), start + F.pmod(F.col(t) - start, F.lit(step)))
    spread = cut.withColumn("_at", F.explode(F.sequence(start, F.least(F.col("_until"), (F.col("_run") + 1) * span - 1), F.lit(step).cast("long"))))
    added = F.col("_at") != F.col(t)
    kept = [F.when(~added, F.col(c)).alias(c) for c in rows.columns if c not in (by, t)]
    return spread.select(by, F.col("_at").alias(t), *kept, added.alias("concealed"))
