"""Rational time: exact rescaling, clock texts, clock positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_of(ticks: Column, num: int | Column, den: int | Column) -> Column:
    """ticks * num / den as a double."""
    return ticks.cast("double") * num / den


def to_ticks(seconds: Column, num: int, den: int) -> Column:
    """Nearest tick, halves away from zero."""
    return F.round(seconds / (F.lit(num).cast("double") / den)).cast("long")


def rescale(ticks: Column, from_num: int, from_den: int, to_num: int, to_den: int, rounding: str = "nearest") -> Column:
    """Ticks of one time base in another, exactly, in 128-bit integers; null on overflow.

    rounding: nearest (halves away from zero), down (towards minus infinity), zero.
    """
    up = F.lit(from_num * to_den).cast("decimal(38,0)")
    down = F.lit(from_den * to_num).cast("decimal(38,0)")
    product = F.try_multiply(ticks.cast("decimal(19,0)"), up.cast("decimal(19,0)"))
    size = F.abs(product)
    whole = F.expr("0").cast("decimal(38,0)") + (size - size % down) / down
    whole = F.round(whole, 0).cast("decimal(38,0)")
    rest = size % down
    if rounding == "nearest":
        whole = whole + F.when(rest * 2 >= down, 1).otherwise(0)
    elif rounding == "down":
        whole = whole + F.when((product < 0) & (rest > 0), 1).otherwise(0)
    return F.when(product < 0, -whole).otherwise(whole).cast("long")


def rounded_fraction(num: Column, den: Column, digits: int) -> Column:
    """num / den of non-negative whole numbers, rounded half up to so many digits without a binary fraction on the way."""
    doubled = 2 * num.cast("long") * 10**digits + den
    whole = (doubled - doubled % (2 * den)) / (2 * den)  # an exact quotient, so the double is exact too
    return whole / float(10**digits)


def _seconds_text(micros: Column) -> Column:
    """SS.cc of the second within the minute, as printf's %05.2f writes the double: halves by what the double exactly is, equal ones to even.

    Only a half depends on that.  The double's part below one, in steps of 2^-60 (a half
    is 0.005 or more, so it has no finer ones), is held against the half in whole numbers.
    """
    part = micros % 60_000_000
    cents = F.floor((part + 5000) / 10_000)
    seconds = part / F.lit(1e6)
    binary = ((seconds - F.floor(seconds)) * float(1 << 60)).cast("long").cast("decimal(20,0)") * 25
    half = F.floor(part % 1_000_000 / 5000).cast("decimal(10,0)") * F.lit(1 << 57).cast("decimal(20,0)")
    down = (part % 10_000 == 5000) & ((binary < half) | ((binary == half) & (cents % 2 == 1)))
    cents = cents - down.cast("int")
    return F.format_string("%02d.%02d", F.floor(cents / 100), cents % 100)


def clock_hours(micros: Column) -> Column:
    """HH:MM:SS.cc; the seconds are rounded by formatting, so 59.999 s reads 60.00."""
    hours, minutes = F.floor(micros / 3_600_000_000), F.floor(micros / 60_000_000) % 60
    return F.format_string("%02d:%02d:%s", hours, minutes, _seconds_text(micros))


def clock_minutes(micros: Column) -> Column:
    """MM:SS.cc with unbounded minutes."""
    return F.format_string("%02d:%s", F.floor(micros / 60_000_000), _seconds_text(micros))


def overlay_clock(seconds: Column) -> Column:
    """M:SS below an hour, H:MM:SS from then on."""
    whole = F.floor(seconds).cast("long")
    short = F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)
    return F.when(whole >= 3600, F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)).otherwise(short)


def clock_position(origin: Column, raw: Column, baseline: Column, rate: Column) -> Column:
    """origin + max(0, raw - baseline / rate)."""
    return origin + F.greatest(F.lit(0.0), raw - baseline / rate)


def sample_clock(samples: Column, rate: int) -> Column:
    """struct(seconds, nanos) in integers."""
    return F.struct((F.floor(samples / rate)).cast("long").alias("seconds"), F.floor((samples % rate) * 1_000_000_000 / rate).cast("long").alias("nanos"))


def volume(level: Column, delta_points: Column) -> Column:
    """Level changed by percentage points, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), level + delta_points / 100))
