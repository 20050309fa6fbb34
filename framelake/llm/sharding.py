"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys hash onto POSITIONS ring positions.  A position belongs to the next virtual
node clockwise; when that node's shard has no room below (1 + SLACK) times the
mean load, the position's keys continue clockwise to the next node whose shard
has.  Loads are bytes, so shards end near equal (law ``bytes``).  Heavy positions
are placed first.  The main path is DataFrame functions only: one grouped sum per
position, of which POSITIONS rows at most reach the driver, and one window per
position for the slots.  A third of all rows in one source, text or group is no
matter, as keys are document ids.

Cases: a null text has no bytes and size 1; a null doc_id is placed by its text;
rows with equal ids share a position and get slots of their own; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

POSITION_BITS = 16
POSITIONS = 1 << POSITION_BITS
VIRTUAL_NODES, SLACK = 128, 0.0005


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise."""
    place = lambda s, v: int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:8], 16) % POSITIONS
    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def assign(loads: dict[int, int], shards: int, slack: float = SLACK, virtual_nodes: int = VIRTUAL_NODES) -> dict[int, int]:
    """Shard of every loaded position, heaviest position first."""
    nodes = ring(shards, virtual_nodes)
    places = [p for p, _ in nodes]
    most = (1 + slack) * sum(loads.values()) / shards
    filled, out = [0] * shards, {}
    for position, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        at, seen = bisect_left(places, position), set()
        chosen = None
        for step in range(len(nodes)):
            shard = nodes[(at + step) % len(nodes)][1]
            if shard in seen:
                continue
            if filled[shard] + load <= most:
                chosen = shard
                break
            seen.add(shard)
            if len(seen) == shards:
                break
        if chosen is None:  # no shard has room for so large a position: the emptiest takes it
            chosen = min(range(shards), key=lambda s: (filled[s], s))
        filled[chosen] += load
        out[position] = chosen
    return out


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size long, text_crc32 long, shard int, slot long) of every row; slots count from 0 in each shard."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")
    items = docs.select(F.col(key).alias("_id"), size.alias("size"), crc.alias("text_crc32"))
    point = F.when(F.col("_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("_id"))
    items = cut(items.withColumn("_point", point).withColumn("_position", F.shiftrightunsigned("_point", 64 - POSITION_BITS).cast("int")))
    table = cut(items.groupBy("_position").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("rows")))
    chosen = assign({r["_position"]: r["load"] for r in table.select("_position", "load").collect()}, shards)  # POSITIONS rows at most
    width = len(str(shards - 1))
    codes = F.lit("".join(f"{chosen.get(p, 0):0{width}d}" for p in range(POSITIONS)))
    table = table.withColumn("shard", F.substring(codes, F.col("_position") * width + 1, F.lit(width)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_position").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select("_position", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_position").orderBy("_point", "_id", "text_crc32", "size")
    numbered = items.withColumn("_rank", F.row_number().over(within)).join(F.broadcast(table), "_position")
    return numbered.select(F.col("_id").alias(key), "size", "text_crc32", "shard", (F.col("_first") + F.col("_rank") - 1).alias("slot"))
