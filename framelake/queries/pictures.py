"""Pixels, geometry and letterboxing; ``embeddings`` stand for planes and vertices."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..functions import mesh, pixel
from ..operators import metrics
from ..operators.blocked import ORDINALS
from ..operators.streams import number
from .registrar import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

_T = "t AS (SELECT vec_id, i::INT AS i, embedding[i * 3 + 1]::DOUBLE AS x, embedding[i * 3 + 2]::DOUBLE AS y, embedding[i * 3 + 3]::DOUBLE AS z FROM embeddings, range(0, 21) r(i))"


def _triples(spark, sf_dir):
    v = tables.vectors(spark, sf_dir).select(F.col("frame_no").alias("vec_id"), "samples", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    return v.select("vec_id", "i", *(F.get("samples", F.col("i") * 3 + n).alias(name) for n, name in enumerate("xyz")))


@query(f"WITH {_T} SELECT vec_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, count(*)::BIGINT AS vertices FROM t GROUP BY 1")
def bbox(spark, sf_dir):
    ends = [f(axis).alias(f"{f.__name__}_{axis}") for axis in "xyz" for f in (F.min, F.max)]
    return _triples(spark, sf_dir).groupBy("vec_id").agg(*ends, F.count(F.lit(1)).alias("vertices"))


@query(f"""
WITH {_T}, e AS (SELECT vec_id, list_sort([max(x) - min(x), max(y) - min(y), max(z) - min(z)]) AS d FROM t GROUP BY 1)
SELECT vec_id, round(d[1] / d[3], 5) AS small, round(d[2] / d[3], 5) AS middle FROM e""")
def sorted_dims(spark, sf_dir):
    spans = F.array_sort(F.array(*(F.max(a) - F.min(a) for a in "xyz")))
    e = _triples(spark, sf_dir).groupBy("vec_id").agg(spans.alias("d"))
    return e.select("vec_id", F.round(F.get("d", 0) / F.get("d", 2), 5).alias("small"), F.round(F.get("d", 1) / F.get("d", 2), 5).alias("middle"))


@query(f"WITH {_T}, k AS (SELECT vec_id, n::INT AS n, ((n * 7 + vec_id) % 21)::INT AS i FROM embeddings, range(0, 36) r(n)) SELECT k.vec_id, k.n, k.i, t.x, t.y, t.z FROM k JOIN t USING (vec_id, i)")
def index_resolve(spark, sf_dir):
    """Index buffers resolved against their vertices, order kept in n."""
    indices = tables.vectors(spark, sf_dir).select(F.col("frame_no").alias("vec_id"), F.explode(F.sequence(F.lit(0), F.lit(35))).alias("n"))
    return indices.withColumn("i", ((F.col("n") * 7 + F.col("vec_id")) % 21).cast("int")).join(_triples(spark, sf_dir), ["vec_id", "i"]).select("vec_id", "n", "i", "x", "y", "z")


@query(f"""
WITH {_T}, r AS (SELECT label, floor(x * 2)::INT AS x, floor(y * 2)::INT AS y, floor(z * 2)::INT AS z, min(vec_id * 100 + i) AS seen, count(*)::BIGINT AS uses FROM t JOIN embeddings USING (vec_id) GROUP BY 1, 2, 3, 4)
SELECT label, x, y, z, uses, (row_number() OVER (PARTITION BY label ORDER BY seen) - 1)::BIGINT AS vertex FROM r""")
def vertex_pool(spark, sf_dir):
    """Equal vertices of a mesh once, numbered as first seen."""
    labels = tables.vectors(spark, sf_dir).select(F.col("frame_no").alias("vec_id"), F.col("stream_index").alias("label"))
    t = _triples(spark, sf_dir).join(labels, "vec_id")
    cell = [F.floor(F.col(a) * 2).cast("int").alias(a) for a in "xyz"]
    pool = t.groupBy("label", *cell).agg(F.min(F.col("vec_id") * 100 + F.col("i")).alias("seen"), F.count(F.lit(1)).alias("uses"))
    return pool.select("label", "x", "y", "z", "uses", "seen").transform(lambda p: number(p, "label", "seen", "vertex", ORDINALS)).drop("seen")


@query(f"""
WITH {_T} SELECT vec_id, i, round(x + 1.5748 * (z - 0.5), 5) AS r, round(x - 0.1873 * (y - 0.5) - 0.4681 * (z - 0.5), 5) AS g, round(x + 1.8556 * (y - 0.5), 5) AS b,
  round(0.2126 * x + (1 - 0.2126 - 0.0722) * y + 0.0722 * z, 5) AS gray FROM t""")
def yuv_to_rgb(spark, sf_dir):
    x, y, z = (F.col(a) for a in "xyz")
    r, g, b = pixel.yuv_to_rgb_709(x, y, z)
    return _triples(spark, sf_dir).select("vec_id", "i", F.round(r, 5).alias("r"), F.round(g, 5).alias("g"), F.round(b, 5).alias("b"), F.round(pixel.gray_of(x, y, z), 5).alias("gray"))


@query("""
WITH p AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, round(abs(embedding[i + 1]) * 1000)::BIGINT AS v FROM embeddings, range(0, 64) r(i))
SELECT vec_id, (x // 3)::INT AS bx, (y // 3)::INT AS by, (sum(v) // 9)::BIGINT AS v FROM p GROUP BY 1, 2, 3 HAVING count(*) = 9""")
def box_downsample(spark, sf_dir):
    """8 x 8 planes by a factor of 3: edges that fill no block are left out."""
    v = tables.vectors(spark, sf_dir).select(F.col("frame_no").alias("vec_id"), F.posexplode("samples").alias("i", "s"))
    level = F.round(F.abs(F.col("s").cast("float")) * F.lit(1000).cast("float")).cast("long")  # in single precision, which the table has
    p = v.select("vec_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), level.alias("v"))
    return metrics.box_downsample(p, "vec_id", "x", "y", "v", 3)


@query("""
SELECT p_partkey, CASE WHEN w * oh > h * ow THEN 0 ELSE (ow - round(oh * w / h)::INT) // 2 END::INT AS x, CASE WHEN w * oh > h * ow THEN (oh - round(ow * h / w)::INT) // 2 ELSE 0 END::INT AS y,
  CASE WHEN w * oh > h * ow THEN ow ELSE round(oh * w / h)::INT END::INT AS w, CASE WHEN w * oh > h * ow THEN round(ow * h / w)::INT ELSE oh END::INT AS h
FROM (SELECT p_partkey, (p_size * 16)::DOUBLE AS w, (p_partkey % 50 * 9 + 10)::DOUBLE AS h, 640 AS ow, 480 AS oh FROM part)""")
def fit_rect(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 16).cast("double").alias("w"), (F.col("p_partkey") % 50 * 9 + 10).cast("double").alias("h"))
    return part.withColumn("r", pixel.fit_rect(F.col("w"), F.col("h"), F.lit(640), F.lit(480))).select("p_partkey", "r.x", "r.y", "r.w", "r.h")


@query(f"""
WITH {_T} SELECT vec_id, i, round(CASE vec_id % 3 WHEN 0 THEN z ELSE x END * 0.01, 6) AS x, round(CASE vec_id % 3 WHEN 1 THEN z ELSE y END * 0.01, 6) AS y, round(CASE vec_id % 3 WHEN 1 THEN y WHEN 0 THEN x ELSE z END * 0.01, 6) AS z,
  abs(x - y) < 1e-3 OR abs(x - y) < 1e-2 * greatest(abs(x), abs(y)) AS near FROM t""")
def canonical_extents(spark, sf_dir):
    up = F.get(F.array(*map(F.lit, "XYZ")), (F.col("vec_id") % 3).cast("int"))
    t = _triples(spark, sf_dir)
    t = t.withColumn("c", mesh.canonical_extents(F.col("x"), F.col("y"), F.col("z"), up, F.lit(0.01))).withColumn("near", mesh.approx_eq(F.col("x"), F.col("y")))
    return t.select("vec_id", "i", *(F.round(F.col("c")[a], 6).alias(a) for a in "xyz"), "near")


@query(f"""
WITH {_T} SELECT vec_id, i, round(x + 0.25 * y + 0.5 * z, 5) AS mx, round(y + 0.25 * z + 0.5 * x, 5) AS my,
  round(cos(0.5) * (x * 2) + sin(0.5) * (y * 3) + 0.1, 5) AS u, round(-sin(0.5) * (x * 2) + cos(0.5) * (y * 3) + 0.2, 5) AS v FROM t""")
def morph_and_uv(spark, sf_dir):
    """Two morph targets folded into a position, and a texture transform."""
    x, y, z = (F.col(a) for a in "xyz")
    moved = mesh.morph(F.array(x, y), F.array(F.array(y, z), F.array(z, x)), F.array(F.lit(0.25), F.lit(0.5)))
    uv = mesh.uv_transform(x, y, 0.1, 0.2, 0.5, 2.0, 3.0)
    t = _triples(spark, sf_dir).withColumns({"m": moved, "t": uv})
    return t.select("vec_id", "i", F.round(F.get("m", 0), 5).alias("mx"), F.round(F.get("m", 1), 5).alias("my"), F.round("t.u", 5).alias("u"), F.round("t.v", 5).alias("v"))


@query("SELECT l_orderkey, l_linenumber, round((l_partkey % 64) / 63.0, 6) AS gradient, (((l_partkey % 64) // 8 + (l_suppkey % 48) // 8) % 2)::DOUBLE AS pattern FROM lineitem")
def generated_pictures(spark, sf_dir):
    """Two generators at the pixel of every line."""
    from ..sources import generate

    x, y = F.col("l_partkey") % 64, F.col("l_suppkey") % 48
    gradient, pattern = (generate.image_value(kind, x, y, 64, 48, {}) for kind in ("gradient", "pattern"))
    return tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(gradient, 6).alias("gradient"), pattern.alias("pattern"))
