"""Filters with feedback over whole streams in blocks, against recursive SQL."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from .. import tables
from ..operators import filters
from .registrar import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

#: Event ids of a block: few, so that small tables have several blocks too.
WIDTH = 1 << 11
_NUMBERED = "e AS (SELECT event_type AS k, event_id AS id, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)"


def _samples(spark, sf_dir):
    return tables.packets(spark, sf_dir).select("stream_key", "ordinal", "value")


def _recursive(state: dict[str, str], shown: str) -> str:
    """State by state along every stream: ``x`` is the sample, ``r.name`` the state before it, 0 at the start."""
    first = ", ".join(f"({_zeroed(v, state)})::DOUBLE AS {name}" for name, v in state.items())
    then = ", ".join(re.sub(r"\bx\b", "e.x", v) for v in state.values())
    return f"WITH RECURSIVE {_NUMBERED}, r AS (SELECT k, n, id, {first} FROM e WHERE n = 1 UNION ALL SELECT e.k, e.n, e.id, {then} FROM r JOIN e ON e.k = r.k AND e.n = r.n + 1) SELECT id AS event_id, {shown} FROM r"


def _zeroed(expression: str, state: dict[str, str]) -> str:
    for name in state:
        expression = expression.replace(f"r.{name}", "0.0")
    return expression


def _section_sql(kind: str, freq: float, rate: float, q: float, gain_db: float, source: str = "x", suffix: str = "") -> dict[str, str]:
    """The states of one section whose input is ``source``: its output y and two memories."""
    b, a = (v.tolist() for v in filters.biquad_coefficients(kind, freq, rate, q, gain_db))
    y = f"({b[0]!r} * {source} + r.u{suffix})"
    return {f"y{suffix}": y, f"u{suffix}": f"({b[1]!r} * {source} - {a[1]!r} * {y} + r.v{suffix})", f"v{suffix}": f"({b[2]!r} * {source} - {a[2]!r} * {y})"}


@query(_recursive(_section_sql("lowpass", 3000, 48_000, 0.9, 0), "round(y, 4) AS value"))
def biquad_blocks(spark, sf_dir):
    out = filters.biquad(_samples(spark, sf_dir), "stream_key", "ordinal", "lowpass", 3000, 48_000, 0.9, width=WIDTH)
    return out.select(F.col("ordinal").alias("event_id"), F.round("value", 4).alias("value"))


_BANDS = [("lowshelf", 800.0, 0.7, 4.0), ("peak", 5000.0, 1.2, -6.0), ("highshelf", 12_000.0, 0.7, 3.0)]
_CHAIN: dict[str, str] = {}
for _i, (_kind, _freq, _q, _gain) in enumerate(_BANDS):
    _CHAIN |= _section_sql(_kind, _freq, 48_000, _q, _gain, _CHAIN[f"y{_i - 1}"] if _i else "x", str(_i))


@query(_recursive(_CHAIN, "round(y2, 4) AS value"))
def equalizer_blocks(spark, sf_dir):
    """Two shelves and a peak in one reading."""
    out = filters.equalizer(_samples(spark, sf_dir), "stream_key", "ordinal", 48_000, _BANDS, WIDTH)
    return out.select(F.col("ordinal").alias("event_id"), F.round("value", 4).alias("value"))


_LOW = _section_sql("lowpass", 6000, 48_000, np.sqrt(0.5), 0, suffix="0")
_LOW |= _section_sql("lowpass", 6000, 48_000, np.sqrt(0.5), 0, _LOW["y0"], "1")
_HIGH = _section_sql("highpass", 6000, 48_000, np.sqrt(0.5), 0, suffix="2")
_HIGH |= _section_sql("highpass", 6000, 48_000, np.sqrt(0.5), 0, _HIGH["y2"], "3")


@query(_recursive(_LOW | _HIGH, "round(y1, 4) AS low, round(y3, 4) AS high"))
def crossover_blocks(spark, sf_dir):
    out = filters.crossover(_samples(spark, sf_dir), "stream_key", "ordinal", 6000, 48_000, WIDTH)
    return out.select(F.col("ordinal").alias("event_id"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


_G, _K = float(np.tan(np.pi * 4000 / 48_000)), 1 / 1.5
_A1 = 1 / (1 + _G * (_G + _K))
_V1 = f"({_A1!r} * r.s + {_G * _A1!r} * (x - r.t))"
_V2 = f"(r.t + {_G!r} * {_V1})"


@query(_recursive({"s": f"(2 * {_V1} - r.s)", "t": f"(2 * {_V2} - r.t)", "band": _V1, "low": _V2, "high": f"(x - {_K!r} * {_V1} - {_V2})"}, "round(low, 4) AS low, round(band, 4) AS band, round(high, 4) AS high"))
def state_variable_blocks(spark, sf_dir):
    out = filters.state_variable(_samples(spark, sf_dir), "stream_key", "ordinal", 4000, 48_000, 1.5, WIDTH)
    return out.select(F.col("ordinal").alias("event_id"), *(F.round(c, 4).alias(c) for c in ("low", "band", "high")))


# the gain in twelfths: it opens over 3 samples and closes over 4
_LOUD = "abs(x) >= 150"
_GAIN = f"(CASE WHEN {_LOUD} THEN least(12, r.g + 4) WHEN r.held > 0 THEN r.g ELSE greatest(0, r.g - 3) END)"


@query(_recursive({"g": _GAIN, "held": f"(CASE WHEN {_LOUD} THEN 5.0 ELSE greatest(r.held - 1, 0) END)", "y": f"(x * {_GAIN} / 12)"}, "round(y, 4) AS value"))
def gate_blocks(spark, sf_dir):
    out = filters.noise_gate(_samples(spark, sf_dir), "stream_key", "ordinal", 150.0, 3, 5, 4, WIDTH)
    return out.select(F.col("ordinal").alias("event_id"), F.round("value", 4).alias("value"))


@query(f"""
WITH RECURSIVE {_NUMBERED}, r AS (SELECT k, n, id, x AS line, 0.0::DOUBLE AS back FROM e WHERE n <= 7 UNION ALL SELECT e.k, e.n, e.id, e.x + 0.6 * r.line, r.line FROM r JOIN e ON e.k = r.k AND e.n = r.n + 7)
SELECT r.id AS event_id, round(e.x + 0.4 * back, 4) AS value FROM r JOIN e USING (k, n)""")
def echo_blocks(spark, sf_dir):
    """A delay line of seven samples with feedback."""
    out = filters.echo(_samples(spark, sf_dir), "stream_key", "ordinal", 7, 0.4, 0.6, WIDTH)
    return out.select(F.col("ordinal").alias("event_id"), F.round("value", 4).alias("value"))


@query("""
WITH e AS (SELECT event_type AS k, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n FROM events),
o AS (SELECT p, j, j - p / 4.0 AS o FROM range(0, 4) a(p), range(-11, 13) b(j)),
w AS (SELECT p, j, CASE WHEN o = 0 THEN 1 ELSE sin(pi() * o) / (pi() * o) * cos(pi() * o / 26) * cos(pi() * o / 26) END AS w FROM o),
t AS (SELECT p, j, w / sum(w) OVER (PARTITION BY p) AS w FROM w),
y AS (SELECT e.k, e.n, t.p, sum(t.w * coalesce(f.x, 0)) AS y FROM e CROSS JOIN t LEFT JOIN e f ON f.k = e.k AND f.n = e.n + t.j GROUP BY 1, 2, 3)
SELECT y.k AS stream_key, y.n // 256 AS block, round(max(abs(y)), 4) AS true_peak, round(max(abs(e.x)), 4) AS sample_peak FROM y JOIN e USING (k, n) GROUP BY 1, 2""")
def true_peak_meter(spark, sf_dir):
    """The highest level between samples in blocks of 256, by fourfold oversampling."""
    found = filters.true_peaks(_samples(spark, sf_dir), "stream_key", "ordinal", 256)
    return found.select("stream_key", "block", F.round("true_peak", 4).alias("true_peak"), F.round("sample_peak", 4).alias("sample_peak"))
