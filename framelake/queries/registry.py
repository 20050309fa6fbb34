"""Registry and format resolution over ``part``, ``pages`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..functions import text
from ..operators import registry as op
from ..sources import formats
from .registrar import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


@query("SELECT p_type AS codec, arg_min(p_brand, p_size::BIGINT * 10000000 + p_partkey) AS backend, arg_min(p_size, p_size::BIGINT * 10000000 + p_partkey) AS priority, arg_min(p_partkey, p_size::BIGINT * 10000000 + p_partkey) AS seq FROM part GROUP BY 1")
def resolve_backend(spark, sf_dir):
    return op.resolve(tables.codec_impls(spark, sf_dir))


@query("""
SELECT p_type AS codec, arg_min(p_brand, k) AS backend, arg_min(p_size, k) AS priority, arg_min(p_partkey, k) AS seq
FROM (SELECT *, (p_size + CASE WHEN p_brand LIKE '%1' THEN 1000 ELSE 0 END)::BIGINT * 10000000 + p_partkey AS k FROM part WHERE p_partkey % 7 <> 0) GROUP BY 1""")
def resolve_without_hardware(spark, sf_dir):
    """Hardware only biased against, failed factories skipped."""
    impls = tables.codec_impls(spark, sf_dir)
    return op.resolve(impls, F.col("seq") % 7 != 0, F.when(F.col("backend").endswith("1"), 1000).otherwise(0))


@query("""
SELECT codec, string_agg(backend, ',' ORDER BY priority, seq) AS backends, count(*)::BIGINT AS n
FROM (SELECT p_type AS codec, p_brand AS backend, p_size AS priority, p_partkey AS seq FROM part) GROUP BY 1""")
def list_backends(spark, sf_dir):
    return op.backends(tables.codec_impls(spark, sf_dir))


@query("""
SELECT coalesce(d.name, m.name) AS name, d.name IS NOT NULL AS demux, m.name IS NOT NULL AS mux
FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 30) d FULL JOIN (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 20) m ON d.name = m.name""")
def capability_matrix(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part").withColumnRenamed("p_name", "name")
    return op.capability_matrix(part.where("p_size < 30").select("name"), part.where("p_size > 20").select("name"))


@query("""
SELECT p_partkey, name, CASE WHEN name LIKE '%nvdec%' OR name LIKE '%nvenc%' THEN 'nvidia' WHEN starts_with(name, 'vaapi') OR name LIKE '%\\_vaapi%' ESCAPE '\\' THEN 'vaapi' WHEN name LIKE '%vdpau%' THEN 'vdpau' WHEN name LIKE '%vulkan%' THEN 'vulkan' END AS engine
FROM (SELECT p_partkey, lower(p_type) || ['_nvdec', '_vaapi', '_vdpau', '_vulkan', '_sw', '_nvenc_vulkan'][(p_size % 6)::INT + 1] AS name FROM part)""".replace("\\\\", "\\"))
def engine_for_impl(spark, sf_dir):
    suffix = F.get(F.array(*map(F.lit, ("_nvdec", "_vaapi", "_vdpau", "_vulkan", "_sw", "_nvenc_vulkan"))), F.col("p_size") % 6)
    part = tables.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower("p_type"), suffix).alias("name"))
    return part.withColumn("engine", text.engine_of(F.col("name")))


@query("""
SELECT id, format, score FROM (
  SELECT page_id AS id, CASE WHEN starts_with(html, '<!DOCTYPE html>') THEN 'html' ELSE 'text' END AS format, CASE WHEN starts_with(html, '<!DOCTYPE html>') THEN 100 ELSE 1 END AS score FROM pages
  UNION ALL SELECT -doc_id - 1, 'text', 1 FROM documents WHERE NOT starts_with(text, '<!DOCTYPE html>') AND NOT starts_with(text, 'RIFF'))""")
def probe_magic(spark, sf_dir):
    pages = tables.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("data"), text.extension(F.col("url")).alias("ext"))
    docs = tables.table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("id"), F.col("text").cast("binary").alias("data"), F.lit(None).cast("string").alias("ext"))
    probed = pages.unionByName(docs).withColumn("found", formats.probe(F.col("data"), F.col("ext")))
    return probed.select("id", "found.format", "found.score")


@query("""
SELECT p_partkey, p_type, coalesce(s.n, 0)::BIGINT AS devices, coalesce(s.first_device, '(no caps reported)') AS device FROM part
LEFT JOIN (SELECT n_name, count(*) AS n, min(s_name) AS first_device FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) s
ON lower(s.n_name) = lower(['FRANCE', 'germany', 'Nowhere', 'CANADA'][(p_size % 4)::INT + 1])""")
def device_capabilities(spark, sf_dir):
    devices = tables.table(spark, sf_dir, "supplier").join(tables.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    devices = devices.groupBy(F.lower("n_name").alias("codec")).agg(F.count(F.lit(1)).alias("n"), F.min("s_name").alias("first_device"))
    wanted = F.lower(F.get(F.array(*map(F.lit, ("FRANCE", "germany", "Nowhere", "CANADA"))), F.col("p_size") % 4))
    part = tables.table(spark, sf_dir, "part").withColumn("codec", wanted)
    return part.join(devices, "codec", "left").select("p_partkey", "p_type", F.coalesce("n", F.lit(0)).cast("long").alias("devices"), F.coalesce("first_device", F.lit("(no caps reported)")).alias("device"))


@query("SELECT lower(p_brand) AS id, arg_max(p_name, p_partkey) AS factory, count(*)::BIGINT AS registrations FROM part GROUP BY 1")
def latest_factory(spark, sf_dir):
    return op.latest_factory(tables.table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_name")


@query("SELECT max(length(p_name))::INT AS width, count(DISTINCT p_name)::BIGINT AS names, count(p_name)::BIGINT AS uses FROM part")
def name_width(spark, sf_dir):
    return tables.table(spark, sf_dir, "part").agg(F.max(F.length("p_name")).alias("width"), F.countDistinct("p_name").alias("names"), F.count("p_name").alias("uses"))


@query("""
SELECT p_partkey, (p_size * 1000 * c * b * 8) // 1000 AS kbps FROM (
  SELECT p_partkey, p_size, (p_partkey % 6 + 1)::INT AS c, [1, 2, 3, 4, 8][(p_partkey % 5)::INT + 1] AS b FROM part)""")
def pcm_bitrate(spark, sf_dir):
    width = F.get(F.array(*map(F.lit, (1, 2, 3, 4, 8))), (F.col("p_partkey") % 5).cast("int"))
    kbps = F.expr("cast(p_size as long) * 1000 * c * b * 8 div 1000")
    return tables.table(spark, sf_dir, "part").withColumns({"c": (F.col("p_partkey") % 6 + 1).cast("int"), "b": width}).select("p_partkey", kbps.alias("kbps"))


@query("""
SELECT node, root, depth FROM (
  SELECT 'r' || r_regionkey AS node, 'r' || r_regionkey AS root, 0 AS depth FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def scene_hierarchy(spark, sf_dir):
    """A graph of nodes flattened to its roots, one join a level."""
    text_of = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    region, nation, supplier = (tables.table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    nodes = region.select(text_of("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    nodes = nodes.unionByName(nation.select(text_of("n", "n_nationkey").alias("node"), text_of("r", "n_regionkey").alias("parent")))
    nodes = nodes.unionByName(supplier.select(text_of("s", "s_suppkey").alias("node"), text_of("n", "s_nationkey").alias("parent")))
    return op.flattened_nodes(nodes)


@query("""
SELECT codec, name, coalesce(value, d) AS value, CASE WHEN k IS NULL THEN 'unknown option' WHEN value IS NOT NULL AND NOT regexp_full_match(value, '[0-9]{1,10}') THEN 'not a u32' END AS problem FROM (
  SELECT coalesce(g.codec, s.codec) AS codec, coalesce(g.name, s.name) AS name, g.value, s.d, s.k FROM (SELECT p_type AS codec, p_brand AS name, any_value(CASE WHEN p_partkey % 3 = 0 THEN 'x' || p_partkey ELSE p_partkey::VARCHAR END ORDER BY p_partkey) AS value FROM part WHERE p_size > 40 GROUP BY 1, 2) g
  FULL JOIN (SELECT DISTINCT p_type AS codec, p_brand AS name, 'u32' AS k, '7' AS d FROM part WHERE p_size <= 20) s ON g.codec = s.codec AND g.name = s.name)""")
def option_schema(spark, sf_dir):
    """Options given for codecs, checked against their schema, with defaults."""
    part = tables.table(spark, sf_dir, "part").withColumnsRenamed({"p_type": "codec", "p_brand": "name"})
    value = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
    given = part.where("p_size > 40").groupBy("codec", "name").agg(F.min_by(value, "p_partkey").alias("value"))
    schema = part.where("p_size <= 20").select("codec", "name", F.lit("u32").alias("kind"), F.lit(None).cast("array<string>").alias("variants"), F.lit("7").alias("default")).distinct()
    return op.checked_options(given, schema)
