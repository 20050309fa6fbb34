"""Pictures as pixel rows: distances and nearest sites, error diffusion, palettes by an octree.

A picture is (by, x, y, value); by may be a struct, for example of a picture and a channel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Distances


def _envelope(columns: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parabolas (x - c)^2 + h^2 of ascending columns that are lowest somewhere: (index, first x of each).

    Whole numbers throughout; where two are equal the one of the smaller column counts.
    """
    kept: list[int] = []
    first: list[int] = []
    c, base = columns.tolist(), (columns * columns + heights * heights).tolist()
    for i in range(len(c)):
        start = None
        while kept:
            j = kept[-1]
            start = (base[i] - base[j]) // (2 * (c[i] - c[j])) + 1
            if start > first[-1]:
                break
            kept.pop()
            first.pop()
        kept.append(i)
        first.append(start if len(kept) > 1 else -(1 << 62))
    return np.array(kept, np.int64), np.array(first, np.int64)


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before."""
    if pa.types.is_struct(column.type):
        return np.logical_or.reduce([_changes(column.is_null()), *map(_changes, column.flatten())])
    codes = column.dictionary_encode().indices.fill_null(-1).to_numpy()
    return np.concatenate([[False], codes[1:] != codes[:-1]])


def _nearest_along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (by, x, y, site_y, value) in order of (by, y, x), each with its columns' nearest sites: the nearest ones of its pixels."""

    def nearest(lines: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        by, xs, ys, sites, values = lines.columns
        x, y, known = xs.to_numpy(), ys.to_numpy(), sites.is_valid().to_numpy(zero_copy_only=False)
        site_y = sites.fill_null(0).to_numpy()
        best = np.full(len(x), -1)
        for a, b in zip(starts, [*starts[1:], len(x)]):
            at = a + np.flatnonzero(known[a:b])
            if len(at):
                kept, first = _envelope(x[at], site_y[at] - y[a])
                best[a:b] = at[kept[np.searchsorted(first, x[a:b], side="right") - 1]]
        none = best < 0
        found = [(x - x[best]) ** 2 + (y - site_y[best]) ** 2, x[best], site_y[best]]
        value = values.take(pa.array(best, pa.int64(), mask=none))
        return pa.RecordBatch.from_arrays([by, xs, ys, *(pa.array(c, pa.int64(), mask=none) for c in found), value], names=[lines.schema.names[0], "x", "y", "distance2", "site_x", "site_y", "value"])

    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        changed = _changes(batch.column(0)) | _changes(batch.column(2))
        starts = np.concatenate([[0] * bool(batch.num_rows), np.flatnonzero(changed)]).astype(np.int64)
        if len(starts) > 1:
            yield nearest(batch.slice(0, starts[-1]), starts[:-1])
        rest = batch.slice(starts[-1]) if len(starts) else None  # its line may go on in the next batch
    if rest is not None:
        yield nearest(rest, np.zeros(1, np.int64))


def nearest_sites(pixels: DataFrame, by: str, site: Column, value: str | None = None) -> DataFrame:
    """(by, x, y, distance2, site_x, site_y): the exact squared distance of every pixel to the nearest site, and which that is.

    Of equally near sites the one of the smallest (x, y) counts; with ``value``, that
    column of it follows.  Two passes over lines, so a line of a picture is the most
    that a task holds: along columns the sites before and behind, each by a running
    window; along rows, sorted by Spark and read in batches, the lower envelope of the
    columns' parabolas.  Pixels of a picture without a site have nulls.
    """
    running = Window.partitionBy(by, "x").rowsBetween(Window.unboundedPreceding, 0)
    here = F.when(site, F.struct(F.col("y").cast("long").alias("y"), (F.col(value) if value else F.lit(None).cast("int")).alias("value")))
    rows = pixels.select(by, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), here.alias("_site"))
    rows = rows.withColumn("_a", F.last("_site", ignorenulls=True).over(running.orderBy("y"))).withColumn("_b", F.last("_site", ignorenulls=True).over(running.orderBy(F.desc("y"))))
    nearer = F.when(F.col("_b").isNull() | (F.col("y") - F.col("_a.y") <= F.col("_b.y") - F.col("y")), F.col("_a")).otherwise(F.col("_b"))
    rows = rows.select(by, "x", "y", nearer.alias("_site")).select(by, "x", "y", F.col("_site.y").alias("site_y"), F.col("_site.value").alias("value"))
    schema = StructType([rows.schema[by], *(StructField(c, LongType()) for c in ("x", "y", "distance2", "site_x", "site_y")), StructField("value", rows.schema["value"].dataType)])
    found = rows.repartition(by, "y").sortWithinPartitions(by, "y", "x").mapInArrow(_nearest_along, schema)
    return found.withColumnRenamed("value", value) if value else found.drop("value")


def nearest_fill(pixels: DataFrame, by: str, site: Column) -> DataFrame:
    """(by, x, y, value): every pixel takes the value of its nearest site."""
    return nearest_sites(pixels, by, site, "value").select(by, "x", "y", "value")


# Error diffusion


def diffused(values: np.ndarray, levels: int) -> np.ndarray:
    """Indices of ``levels`` even steps for pictures (n, height, width) of values from 0 to 1, the error going to the right and below.

    All pixels with one x + 2 y depend on earlier ones alone, so they advance together,
    in every picture at once.
    """
    n, height, width = values.shape
    left = np.zeros((n, height + 1, width + 2))
    left[:, :height, 1 : width + 1] = values
    out = np.zeros(values.shape, np.int64)
    top = levels - 1
    for front in range(width + 2 * (height - 1)):
        y = np.arange(max(0, -(-(front - width + 1) // 2)), min(height - 1, front // 2) + 1)
        x = front - 2 * y
        old = left[:, y, x + 1]
        step = np.clip(np.floor(old * top + 0.5), 0, top)
        out[:, y, x] = step
        error = old - step / top
        for dx, dy, share in ((-1, 1, 3), (1, 0, 7), (0, 1, 5), (1, 1, 1)):  # sums in the order of a scan line by line
            left[:, y + dy, x + 1 + dx] += error * (share / 16)
    return out


def error_diffusion(pixels: DataFrame, by: str, levels: int) -> DataFrame:
    """(by, x, y, step int): Floyd-Steinberg dithering of whole pictures, x and y from 0 without gaps.

    A pixel depends on all before it, so a picture is one row, and a batch of rows is
    worked on at once.
    """
    if levels < 2:
        raise ValueError("dithering needs two levels")
    rows = pixels.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("value")))).alias("_p"))
    rows = rows.select(by, (F.element_at("_p", -1)["x"] + 1).alias("_w"), F.transform("_p", lambda p: p["value"]).alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, pictures = batch.column(1).to_numpy(), batch.column(2)
            sizes = np.array([len(p) for p in pictures], np.int64)
            found: list = [None] * batch.num_rows
            for width, size in {(int(w), int(s)) for w, s in zip(widths, sizes)}:
                if size % width:
                    raise ValueError("a picture has gaps")
                same = np.flatnonzero((widths == width) & (sizes == size))
                steps = diffused(np.stack([pictures[int(i)].values.to_numpy() for i in same]).reshape(len(same), -1, width), levels)
                for i, picture in zip(same, steps):
                    found[int(i)] = picture.ravel().tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=[by, "_w", "_s"])

    schema = StructType([rows.schema[by], rows.schema["_w"], *StructType.fromDDL("_s array<int>").fields])
    steps = rows.mapInArrow(run, schema).select(by, "_w", F.posexplode("_s").alias("_i", "step"))
    return steps.select(by, (F.col("_i") % F.col("_w")).alias("x"), F.floor(F.col("_i") / F.col("_w")).cast("int").alias("y"), "step")


# Palettes

#: Bits of red, green and blue that the tree looks at: 8 ** DEPTH cells at most.
DEPTH = 5


def _cell(depth: int) -> Column:
    """The tree's cell of a colour at a depth, one digit of three bits a level."""
    bits = lambda c: F.shiftright(F.col(c).cast("int"), 8 - depth)
    out = F.lit(0)
    for i in range(depth):
        digit = sum((F.shiftright(bits(c), i).bitwiseAND(1) * w for c, w in (("r", 4), ("g", 2), ("b", 1))), F.lit(0))
        out = out + digit * 8**i
    return out.cast("int")


def octree_palette(colours: DataFrame, by: str, size: int, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Palettes of at most ``size`` colours: (by, level, cell, slot, r, g, b) and, for every cell of the tree that a picture has, (by, leaf, slot).

    colours: (by, r, g, b), each 0 to 255.  A node is split if so few are as large as
    it that splitting them all leaves no more than ``size`` leaves; equally large ones
    are split together.  Everything is grouped sums of cells: a picture adds up to
    8 ** depth of them, however many pixels it has.
    """
    leaves = colours.select(by, _cell(depth).alias("leaf"), "r", "g", "b").groupBy(by, "leaf").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("long")).alias(c) for c in "rgb"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    above = leaves.select("*", levels.alias("level")).withColumn("cell", F.floor(F.col("leaf") / F.pow(F.lit(8), depth - F.col("level"))).cast("int"))
    below = F.floor(F.col("leaf") / F.pow(F.lit(8), F.greatest(depth - F.col("level") - 1, F.lit(0)))).cast("int")
    nodes = above.withColumn("child", below).groupBy(by, "level", "cell").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in "rgb"), F.count_distinct("child").alias("children"))
    most = Window.partitionBy(by).orderBy(F.desc("n")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inner = nodes.where(F.col("level") < depth).withColumn("total", 1 + F.sum(F.col("children") - 1).over(most))
    split = inner.where(F.col("total") <= size).select(by, "level", "cell")
    # splits are closed upwards, so a leaf's palette entry lies as deep as it has split nodes above it
    deep = above.select(by, "leaf", "level", "cell").join(split, [by, "level", "cell"]).groupBy(by, "leaf").agg(F.count(F.lit(1)).cast("int").alias("level"))
    placed = leaves.select(by, "leaf").join(deep, [by, "leaf"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    placed = placed.withColumn("cell", F.floor(F.col("leaf") / F.pow(F.lit(8), depth - F.col("level"))).cast("int"))
    used = placed.select(by, "level", "cell").distinct().join(nodes, [by, "level", "cell"])
    order = Window.partitionBy(by).orderBy(F.desc("n"), "level", "cell")
    palette = used.select(by, "level", "cell", (F.row_number().over(order) - 1).alias("slot"), *((F.col(c) / F.col("n")).alias(c) for c in "rgb"))
    return palette, placed.join(palette.select(by, "level", "cell", "slot"), [by, "level", "cell"]).select(by, "leaf", "slot")


def octree_mapped(colours: DataFrame, by: str, size: int, depth: int = DEPTH) -> DataFrame:
    """colours (by, r, g, b and any others) with slot, and pr, pg, pb of their palette."""
    palette, slots = octree_palette(colours, by, size, depth)
    entries = slots.join(palette.select(by, "slot", *(F.col(c).alias(f"p{c}") for c in "rgb")), [by, "slot"])
    return colours.withColumn("leaf", _cell(depth)).join(entries, [by, "leaf"]).drop("leaf")
