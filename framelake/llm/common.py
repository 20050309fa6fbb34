"""Plumbing shared by the operators of this subpackage.

Two rules hold everywhere: lineage is cut only with reliable checkpoints in the
session's shared folder, and what is broadcast has a size bound that does not
depend on the number of documents.
"""

from __future__ import annotations

import re
import sys
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bits of a membership bitmap for each of its keys, bits of a block (one row of 4 KB), bits broadcast at once.
BITS_A_KEY, BLOCK_BITS, MOST_BITS = 16, 1 << 15, 1 << 30
#: Readings of the rows for one set; where more would be needed, one shuffle of all rows costs less.
MOST_RANGES = 4
#: A key is hot when it holds more than one in HOT_SHARE of all rows, so at most HOT_SHARE keys are.
HOT_SHARE = 1000
#: Keys of fewer rows are never hot.
HOT_ROWS = 100
BATCH_BYTES = 8 << 20
SPACES = r"[\x20\x09-\x0D]+"

# Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of the session held to BATCH_BYTES unless they are smaller.

    Whole texts travel in these batches, on both sides and in several copies.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def schema_with(df: DataFrame, fields: str) -> StructType:
    """df's columns and those of a DDL string."""
    return StructType([*df.schema.fields, *StructType.fromDDL(fields).fields])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset, a temporary one, if the session runs on this machine alone.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return folder or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Members:
    """Bitmaps of a set of evenly spread 64-bit keys, sized by their number.

    With BITS_A_KEY bits a key, 1 - exp(-1 / BITS_A_KEY) of other keys (6.1 %) pass by
    chance.  Beyond MOST_BITS bits the keys are dealt to ranges, each with a bitmap of
    its own and a reading of the rows of its own.  A set that needs more than MOST_RANGES
    of these has no bitmap: every row with a key may be in it, and the exact test that
    follows everywhere shuffles them all, once.
    """

    def __init__(self, keys: DataFrame, key: str):
        """keys: a checkpointed or cheap table with distinct keys in column ``key``."""
        wanted = max(BLOCK_BITS, keys.count() * BITS_A_KEY)
        self.ranges = -(-wanted // MOST_BITS)
        self.bits = min(MOST_BITS, 1 << (-(-wanted // self.ranges) - 1).bit_length())
        if self.ranges > MOST_RANGES:
            return

        def fill(block: tuple, table: pa.Table) -> pa.Table:
            bits = np.zeros(BLOCK_BITS, np.uint8)
            bits[table.column("_bit").to_numpy()] = 1
            return pa.table({"_part": table.column("_part").slice(0, 1), "_block": table.column("_block").slice(0, 1), "_mask": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        slots = self._placed(keys.select(F.col(key).alias("_member")), "_member").select("_part", "_block", "_bit")
        self.masks = cut(slots.groupBy("_part", "_block").applyInArrow(fill, "_part int, _block int, _mask binary"))

    def _placed(self, df: DataFrame, key: str) -> DataFrame:
        """df with _part, _block and _bit of the key, none of them ever null.

        A null would let Spark test the key for null by itself and compute it, however costly, once more for that.
        """
        slot = F.coalesce(F.pmod(F.col(key), F.lit(self.bits)), F.lit(-1))
        part = F.coalesce(F.pmod(F.shiftrightunsigned(F.col(key), 32), F.lit(self.ranges)), F.lit(0)).cast("int")
        placed = df.withColumn("_slot", slot).withColumn("_part", part if self.ranges > 1 else F.lit(0))
        return placed.withColumns({"_block": F.shiftright("_slot", BLOCK_BITS.bit_length() - 1).cast("int"), "_bit": F.col("_slot").bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")}).drop("_slot")

    def _split(self, df: DataFrame, key: str, inside: bool) -> DataFrame:
        if self.ranges > MOST_RANGES:
            return df.where(F.col(key).isNotNull() if inside else F.col(key).isNull())
        byte = F.conv(F.hex(F.substring("_mask", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("long")
        hit = F.getbit(byte, F.col("_bit").bitwiseAND(7)) == 1
        rows, out = self._placed(df, key), None
        for part in range(self.ranges):
            mask = F.broadcast(self.masks.where(F.col("_part") == part).select("_block", "_mask"))
            mine = rows.where(F.col("_part") == part) if self.ranges > 1 else rows
            some = mine.join(mask, "_block").where(hit) if inside else mine.join(mask, "_block", "left").where(F.col("_mask").isNull() | ~hit)
            out = some if out is None else out.unionByName(some)
        return out.drop("_part", "_block", "_bit", "_mask")

    def possibly(self, df: DataFrame, key: str) -> DataFrame:
        """Rows whose key may be in the set; few others pass, or all of a set without a bitmap."""
        return self._split(df, key, True)

    def surely_not(self, df: DataFrame, key: str) -> DataFrame:
        """The rows that possibly() leaves out, rows with a null key included."""
        return self._split(df, key, False)


def only(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows whose non-null key is in wanted: all others but a few stay where they are read.

    A plain semi-join would be pushed below the bitmap and shuffle every row, so
    the exact test is an inner join with distinct keys; it always shuffles, at any size.
    """
    ids = cut(wanted.where(F.col(key).isNotNull()).select(key).distinct())
    members = Members(ids.select(F.xxhash64(key).alias("_h")), "_h")
    return members.possibly(rows.withColumn("_h", F.xxhash64(key)), "_h").drop("_h").join(ids.hint("merge"), key).select(*rows.columns)


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs less those whose key is in dropped; only rows that may match are shuffled.

    Rows travel as one struct, so no column of theirs can clash with a helper's.
    """
    spread = F.xxhash64(F.col(key))
    ids = cut(dropped.where(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct().withColumns({"_h": F.xxhash64("_key"), "_gone": F.lit(True)}))
    members = Members(ids, "_h")
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), F.when(F.col(key).isNotNull(), spread).alias("_h"))
    doubtful = members.possibly(marked, "_h").join(ids.select("_key", "_gone").hint("merge"), "_key", "left").where("_gone IS NULL")
    return members.surely_not(marked, "_h").select("_row.*").unionByName(doubtful.select("_row.*"))


def hot_bound(total: int, least: int = HOT_ROWS) -> int:
    """A key of more rows than this is hot, of ``total`` rows."""
    return max(least, total // HOT_SHARE)


def join_with_hot_keys(df: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, least: int = HOT_ROWS) -> DataFrame:
    """df left-joined with groups, one row a key at most; ``size`` is the key's number of rows, ``total`` that of df.

    Keys that hold more than total / HOT_SHARE rows (and more than ``least``), of
    which there are fewer than HOT_SHARE, go by broadcast; the others by shuffle,
    none of them large.
    Both inputs are read twice, so they should be checkpointed or cheap.
    """
    if total <= least:  # no key can be hot
        return df.join(groups.hint("merge"), keys, "left")
    hot = F.col(size) > F.lit(hot_bound(total, least))
    few, many = groups.where(hot), groups.where(~hot)
    heavy = df.join(F.broadcast(few), keys)
    light = df.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(many.hint("merge"), keys, "left")
    return heavy.unionByName(light)


def hex_mask(column: Column, digits: int) -> Column:
    """The first ``digits`` (15 at most) hex digits of a digest as a long."""
    return F.conv(F.substring(column, 1, digits), 16, 10).cast("long")
