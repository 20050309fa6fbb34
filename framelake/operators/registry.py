"""Registry resolution: backends by priority, capability matrices, device matching, format lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(impls: DataFrame, usable: Column | None = None, penalty: Column | None = None) -> DataFrame:
    """The backend of each codec with the lowest (penalised) priority among the usable; ties by registration."""
    rows = impls if usable is None else impls.where(usable)
    rank = F.struct((F.col("priority") + (penalty if penalty is not None else F.lit(0))).alias("p"), "seq")
    return rows.groupBy("codec").agg(F.min_by(F.struct("backend", "priority", "seq"), rank).alias("b")).select("codec", "b.backend", "b.priority", "b.seq")


def backends(impls: DataFrame, most: int | None = None) -> DataFrame:
    """Backends of each codec in priority order, joined to one text."""
    ordered = F.array_sort(F.collect_list(F.struct("priority", "seq", "backend")))
    ordered = ordered if most is None else F.slice(ordered, 1, most)
    return impls.groupBy("codec").agg(F.array_join(F.transform(ordered, lambda x: x["backend"]), ",").alias("backends"), F.count(F.lit(1)).alias("n"))


def capability_matrix(demuxers: DataFrame, muxers: DataFrame, name: str = "name") -> DataFrame:
    """name, demux, mux: a full outer union of two lists of names."""
    both = demuxers.select(name, F.lit(True).alias("d"), F.lit(False).alias("m")).unionByName(muxers.select(name, F.lit(False).alias("d"), F.lit(True).alias("m")))
    return both.groupBy(name).agg(F.bool_or("d").alias("demux"), F.bool_or("m").alias("mux"))


def latest_factory(registrations: DataFrame, name: str, seq: str, factory: str) -> DataFrame:
    """For names in any case, the factory registered last."""
    return registrations.groupBy(F.lower(name).alias("id")).agg(F.max_by(factory, seq).alias("factory"), F.count(F.lit(1)).alias("registrations"))


#: Option kinds and what their text must look like; an enum lists its variants instead.
OPTION_KINDS = {"bool": r"^(true|false)$", "u32": r"^[0-9]{1,10}$", "i32": r"^-?[0-9]{1,10}$", "f32": r"^-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$", "string": r"(?s)^.*$"}


def checked_options(params: DataFrame, schema: DataFrame) -> DataFrame:
    """(codec, name, value, problem): given options joined to their schema, defaults filled in.

    params: codec, name, value text; schema: codec, name, kind, variants, default.
    """
    both = schema.join(params, ["codec", "name"], "full")
    wrong = F.lit(False)
    for kind, pattern in OPTION_KINDS.items():
        wrong = wrong | ((F.col("kind") == kind) & ~F.col("value").rlike(pattern))
    wrong = wrong | ((F.col("kind") == "enum") & ~F.array_contains("variants", F.col("value")))
    problem = F.when(F.col("kind").isNull(), "unknown option").when(F.col("value").isNotNull() & wrong, F.concat(F.lit("not a "), "kind"))
    return both.select("codec", "name", F.coalesce("value", "default").alias("value"), problem.alias("problem"))


def stale_probes(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (path, mtime, size) the cache does not know."""
    return listing.join(cache, ["path", "mtime", "size"], "left_anti")


def flattened_nodes(nodes: DataFrame, most_depth: int = 64) -> DataFrame:
    """(node, root, depth) of a scene graph given as (node, parent): one join a level, ended by the deepest."""
    level = nodes.where("parent IS NULL").select("node", F.col("node").alias("root"), F.lit(0).alias("depth"))
    out = level
    for depth in range(1, most_depth + 1):
        level = nodes.join(level.select(F.col("node").alias("parent"), "root"), "parent").select("node", "root", F.lit(depth).alias("depth"))
        if not level.limit(1).count():
            return out
        out = out.unionByName(level)
    raise ValueError(f"scene graph deeper than {most_depth}, or not a tree")


def bench_order(rows: DataFrame, media: str, *then: str) -> list:
    """Sort keys of a benchmark listing: video, audio, the rest, then the given columns."""
    return [F.when(F.col(media) == "Video", 0).when(F.col(media) == "Audio", 1).otherwise(2), *(rows[c] for c in then)]
