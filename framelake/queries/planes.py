"""Distances, nearest sites, error diffusion and palettes of pictures; ``embeddings`` stand for planes of 8 x 8."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..operators import filters, pictures
from .registrar import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

_LEVELS = "g AS (SELECT vec_id, (i % 8)::INT AS x, (i // 8)::INT AS y, floor(abs(embedding[i + 1]::DOUBLE) * 1000)::BIGINT AS k FROM embeddings, range(0, 64) r(i))"


def _levels(spark, sf_dir):
    """(frame_no, x, y, value): whole numbers."""
    v = tables.vectors(spark, sf_dir).select("frame_no", F.posexplode("samples").alias("i", "v"))
    return v.select("frame_no", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.floor(F.abs("v") * 1000).alias("value"))


@query(f"""
WITH {_LEVELS}, n AS (SELECT a.vec_id, a.x, a.y, min(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * 64 + b.x * 8 + b.y) AS key FROM g a LEFT JOIN g b ON a.vec_id = b.vec_id AND b.k % 11 = 0 GROUP BY 1, 2, 3)
SELECT vec_id AS frame_no, x::BIGINT AS x, y::BIGINT AS y, (key // 64)::BIGINT AS distance2, (key % 64 // 8)::BIGINT AS site_x, (key % 8)::BIGINT AS site_y FROM n""")
def distance_transform(spark, sf_dir):
    """Every pixel's nearest site, some six of them in a plane."""
    return pictures.nearest_sites(_levels(spark, sf_dir), "frame_no", F.col("value") % 11 == 0)


@query(f"""
WITH {_LEVELS}, m AS (SELECT vec_id % 20 * 8 + x AS x, vec_id // 20 * 8 + y AS y, k FROM g), s AS (SELECT * FROM m WHERE k % 29 = 0)
SELECT m.x, m.y, min((m.x - s.x) * (m.x - s.x) + (m.y - s.y) * (m.y - s.y))::BIGINT AS distance2, arg_min(s.k, ((m.x - s.x) * (m.x - s.x) + (m.y - s.y) * (m.y - s.y)) * 1048576 * 1024 + s.x * 1048576 + s.y) AS value FROM m, s GROUP BY 1, 2""")
def distance_mosaic(spark, sf_dir):
    """All planes as the tiles of one picture, twenty in a row: distances, and the fill by nearest values."""
    tiles = _levels(spark, sf_dir).select(F.lit(0).alias("p"), (F.col("frame_no") % 20 * 8 + F.col("x")).alias("x"), (F.floor(F.col("frame_no") / 20) * 8 + F.col("y")).alias("y"), "value")
    return pictures.nearest_sites(tiles, "p", F.col("value") % 29 == 0, "value").select("x", "y", "distance2", "value")


@query(f"""
WITH RECURSIVE {_LEVELS}, l AS (SELECT vec_id, list(k % 256 / 255.0 ORDER BY y, x) AS v FROM g GROUP BY 1),
r AS (SELECT vec_id, 0 AS i, v, 0.0::DOUBLE AS e, 0 AS step FROM l
  UNION ALL SELECT vec_id, i + 1,
    list_transform(v, lambda b, j: b + (v[i + 1] - q / 3.0) * CASE WHEN j = i + 2 AND i % 8 < 7 THEN 7 WHEN j = i + 8 AND i % 8 > 0 THEN 3 WHEN j = i + 9 THEN 5 WHEN j = i + 10 AND i % 8 < 7 THEN 1 ELSE 0 END / 16.0), v[i + 1], q
  FROM (SELECT *, least(3, greatest(0, floor(v[i + 1] * 3 + 0.5)))::INT AS q FROM r WHERE i < 64))
SELECT vec_id AS frame_no, (i - 1) % 8 AS x, (i - 1) // 8 AS y, step FROM r WHERE i > 0""")
def diffused_planes(spark, sf_dir):
    """Planes in four levels, errors diffused."""
    return pictures.error_diffusion(_levels(spark, sf_dir).withColumn("value", F.col("value") % 256 / 255), "frame_no", 4)


_CELL = " + ".join(f"(((r >> {3 + i}) & 1) * 4 + ((g >> {3 + i}) & 1) * 2 + ((b >> {3 + i}) & 1)) * {8**i}" for i in range(5))


@query(f"""
WITH c AS (SELECT vec_id % 3 AS p, list_transform(embedding[3 * i + 1:3 * i + 3], lambda e: floor(abs(e::DOUBLE) * 1000)::BIGINT % 256) AS v FROM embeddings, range(0, 20) t(i)),
d AS (SELECT p, v[1] AS r, v[2] AS g, v[3] AS b FROM c), f AS (SELECT p, {_CELL} AS leaf, r, g, b FROM d),
a AS (SELECT p, leaf, level, leaf // (8 ** (5 - level))::BIGINT AS cell, leaf // (8 ** greatest(4 - level, 0))::BIGINT AS child, r, g, b FROM f, range(0, 6) t(level)),
n AS (SELECT p, level, cell, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b, count(DISTINCT child) AS children FROM a GROUP BY 1, 2, 3),
o AS (SELECT *, 1 + sum(children - 1) OVER (PARTITION BY p ORDER BY n DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM n WHERE level < 5),
s AS (SELECT p, level, cell FROM o WHERE total <= 40), k AS (SELECT a.p, a.leaf, count(DISTINCT a.level) AS level FROM a JOIN s USING (p, level, cell) GROUP BY 1, 2),
u AS (SELECT p, leaf, coalesce(level, 0) AS level FROM (SELECT DISTINCT p, leaf FROM f) LEFT JOIN k USING (p, leaf)),
e AS (SELECT DISTINCT p, level, leaf // (8 ** (5 - level))::BIGINT AS cell FROM u)
SELECT p, (row_number() OVER (PARTITION BY p ORDER BY n DESC, level, cell) - 1)::INT AS slot, n AS pixels, round(r, 4) AS pr, round(g, 4) AS pg, round(b, 4) AS pb FROM e JOIN n USING (p, level, cell)""")
def octree_colours(spark, sf_dir):
    """Three pictures of many colours in forty at most, and how many pixels each takes."""
    v = tables.vectors(spark, sf_dir).select((F.col("frame_no") % 3).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"), "samples")
    level = lambda n: (F.floor(F.abs(F.get("samples", F.col("i") * 3 + n)) * 1000) % 256).cast("int")
    mapped = pictures.octree_mapped(v.select("p", *(level(n).alias(c) for n, c in enumerate("rgb"))), "p", 40)
    return mapped.groupBy("p", "slot", *(F.round(c, 4).alias(c) for c in ("pr", "pg", "pb"))).agg(F.count(F.lit(1)).alias("pixels"))


_W = "exp(-(dx * dx + dy * dy) / 1.28) * cos(2 * pi() * (dx * cos(0.5) + dy * sin(0.5)) / 3 + 0.25)"


@query(f"""
WITH {_LEVELS}, t AS (SELECT a.d AS dx, b.d AS dy FROM (SELECT d - 2 AS d FROM range(0, 5) r(d)) a, (SELECT d - 2 AS d FROM range(0, 5) r(d)) b), w AS (SELECT dx, dy, {_W} AS w FROM t)
SELECT a.vec_id AS frame_no, a.x, a.y, round(sum(b.k * w), 3) AS value FROM g a JOIN g b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 JOIN w ON w.dx = b.x - a.x AND w.dy = b.y - a.y GROUP BY 1, 2, 3""")
def gabor_planes(spark, sf_dir):
    """Planes answered by a wave of one direction."""
    out = filters.convolve(_levels(spark, sf_dir), "frame_no", filters.gabor(3.0, 0.5, 0.8, 0.25))
    return out.select("frame_no", "x", "y", F.round("value", 3).alias("value"))


@query(f"""
WITH {_LEVELS} SELECT a.vec_id AS frame_no, a.x, a.y, (a.k >= avg(b.k) + 0.3 * stddev_pop(b.k))::INT::DOUBLE AS value FROM g a JOIN g b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY 1, 2, 3, a.k""")
def local_thresholds(spark, sf_dir):
    return filters.niblack(_levels(spark, sf_dir), "frame_no", 2, 0.3).select("frame_no", "x", "y", "value")
