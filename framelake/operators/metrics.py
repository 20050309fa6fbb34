"""Fidelity metrics between sample arrays, and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def squared_error(a: Column, b: Column) -> Column:
    """Sum of squared differences over the shorter length, without exploding."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def rms(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.when(n == 0, F.lit(float("inf"))).otherwise(F.sqrt(squared_error(a, b) / n))


def psnr(a: Column, b: Column, peak: float) -> Column:
    """0 for nothing to compare, infinite for equal input."""
    n = F.least(F.size(a), F.size(b))
    mse = squared_error(a, b) / F.when(n > 0, n)
    return F.when(n == 0, F.lit(0.0)).when(mse <= 0, F.lit(float("inf"))).otherwise(10 * F.log10(peak * peak / mse))


def correlation(a: str, b: str, window: WindowSpec) -> Column:
    """Pearson correlation of two channels over a window; null where it has one row or a channel does not vary."""
    spread = F.var_pop(a).over(window) * F.var_pop(b).over(window)
    return F.covar_pop(a, b).over(window) / F.nullif(F.sqrt(F.greatest(spread, F.lit(0.0))), F.lit(0.0))


def best_lag(pairs: DataFrame, a: str, b: str, most: int, step: int = 1) -> DataFrame:
    """Adds lag and rms: of lags 0, step, ... most, the first with the least RMS of a[lag:] against b."""
    tried = F.transform(F.sequence(F.lit(0), F.lit(most), F.lit(step)), lambda lag: F.struct(rms(F.slice(F.col(a), lag + 1, F.size(a)), F.col(b)).alias("rms"), lag.alias("lag")))
    return pairs.withColumn("_best", F.array_min(tried)).withColumns({"lag": F.col("_best.lag"), "rms": F.col("_best.rms")}).drop("_best")


def box_downsample(pixels: DataFrame, by: str, x: str, y: str, value: str, factor: int) -> DataFrame:
    """Integer mean of whole factor x factor blocks."""
    bx, by_ = F.floor(F.col(x) / factor).cast("int").alias("bx"), F.floor(F.col(y) / factor).cast("int").alias("by")
    sums = pixels.groupBy(by, bx, by_).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.where(F.col("n") == factor * factor).select(by, "bx", "by", F.floor(F.col("s") / (factor * factor)).cast("long").alias("v"))


def parity(direct: DataFrame, job: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, total, only_direct, only_job): two routes to the same rows, compared as multisets by one grouped sum of signs."""
    signed = direct.withColumn("_sign", F.lit(1)).unionByName(job.withColumn("_sign", F.lit(-1)))
    rows = signed.groupBy(*direct.columns).agg(F.sum("_sign").alias("_left"), F.count_if(F.col("_sign") < 0).alias("_given"))
    surplus = lambda c: F.sum(F.greatest(c, F.lit(0))).cast("long")
    return rows.groupBy(by).agg(F.sum("_given").alias("n"), F.sum(F.col(value) * F.col("_given")).alias("total"), surplus(F.col("_left")).alias("only_direct"), surplus(-F.col("_left")).alias("only_job"))
