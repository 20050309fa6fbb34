"""Side data of scene elements through formats that keep some of it: variants by name, a whitelist a sink, and what each drops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What each mesh format can hold.
KEPT = {
    "stl": ("position", "normal"),
    "obj": ("position", "normal", "uv", "material"),
    "gltf": ("position", "normal", "tangent", "uv", "material", "joints", "weights", "morph", "extras"),
}


def through(elements: DataFrame, sink: str) -> DataFrame:
    """elements (.., attributes map<string, variant>) with what the sink keeps of their attributes."""
    return elements.withColumn("attributes", F.map_filter("attributes", lambda name, _: name.isin(*KEPT[sink])))


def losses(elements: DataFrame, sinks: tuple[str, ...] = tuple(KEPT)) -> DataFrame:
    """(sink, attribute, kept, dropped): how many elements bring an attribute to a sink, and what becomes of it; a null map brings none."""
    brought = elements.select(F.explode(F.map_keys("attributes")).alias("attribute")).groupBy("attribute").agg(F.count(F.lit(1)).alias("n"))
    allowed = F.create_map(*(part for sink in sinks for part in (F.lit(sink), F.array(*map(F.lit, KEPT[sink])))))
    rows = brought.select("attribute", "n", F.explode(F.array(*map(F.lit, sinks))).alias("sink"))
    keeps = F.array_contains(F.element_at(allowed, F.col("sink")), F.col("attribute"))
    return rows.select("sink", "attribute", F.when(keeps, F.col("n")).otherwise(0).alias("kept"), F.when(keeps, 0).otherwise(F.col("n")).alias("dropped"))
