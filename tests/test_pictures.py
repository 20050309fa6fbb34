"""Picture operators against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.operators import pictures

RNG = np.random.default_rng(12)


def frame(spark, grids):
    return spark.createDataFrame([(p, x, y, float(v)) for p, g in grids.items() for y, row in enumerate(g) for x, v in enumerate(row)], "p string, x int, y int, value double").repartition(3)


def test_nearest_sites(spark):
    grids = {"a": RNG.integers(0, 6, (9, 14)), "wide": RNG.integers(0, 40, (2, 90)), "none": np.ones((3, 3)), "all": np.zeros((2, 2)), "dot": np.zeros((1, 1))}
    pixels = frame(spark, grids)
    found = {(r.p, r.x, r.y): (r.distance2, r.site_x, r.site_y) for r in pictures.nearest_sites(pixels, "p", F.col("value") == 0).collect()}
    filled = {(r.p, r.x, r.y): r.value for r in pictures.nearest_fill(pixels.withColumn("value", F.col("value") + 0), "p", F.col("value") <= 1).collect()}
    for p, g in grids.items():
        sites = [(int(x), int(y)) for y, x in zip(*np.nonzero(g == 0))]
        low = [(int(x), int(y)) for y, x in zip(*np.nonzero(g <= 1))]
        for y in range(g.shape[0]):
            for x in range(g.shape[1]):
                near = lambda some: min(((x - a) ** 2 + (y - b) ** 2, a, b) for a, b in some)  # noqa: E731,B023
                assert found[p, x, y] == (near(sites) if sites else (None, None, None))
                assert filled[p, x, y] == (g[near(low)[2], near(low)[1]] if low else None)
    assert pictures.nearest_sites(pixels.limit(0), "p", F.col("value") == 0).count() == 0


def test_nearest_sites_of_long_lines(spark):
    """Lines cut by the batches that Python reads, pictures named by a struct; windows run one way only, so a column costs its length."""
    grids = {"a": RNG.integers(0, 6, (9, 14)), "b": RNG.integers(0, 6, (9, 14)), "tall": RNG.integers(0, 30, (60, 2)), "none": np.ones((3, 3))}
    pixels = frame(spark, grids).select(F.struct("p", F.lit(1).alias("channel")).alias("p"), "x", "y", "value")
    found = pictures.nearest_sites(pixels, "p", F.col("value") == 0, "value")
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == sum(g.size for g in grids.values())
    for r in rows:
        sites = [(int(x), int(y)) for y, x in zip(*np.nonzero(grids[r.p.p] == 0))]
        near = min(((r.x - a) ** 2 + (r.y - b) ** 2, a, b) for a, b in sites) if sites else (None, None, None)
        assert (r.distance2, r.site_x, r.site_y, r.value) == (*near, 0.0 if sites else None)


@settings(max_examples=200, deadline=None)
@given(heights=st.dictionaries(st.integers(-20, 20), st.integers(-15, 15), min_size=1, max_size=12))
def test_envelopes(heights):
    columns = np.array(sorted(heights))
    h = np.array([heights[c] for c in columns.tolist()])
    kept, first = pictures._envelope(columns, h)
    x = np.arange(-40, 41)
    best = kept[np.searchsorted(first, x, side="right") - 1]
    for at, i in zip(x, best):
        assert min(((at - c) ** 2 + g * g, c) for c, g in zip(columns.tolist(), h.tolist())) == ((at - columns[i]) ** 2 + h[i] ** 2, columns[i])


def serial_diffusion(grid, levels):
    v, out, top = grid.astype(float).copy(), np.zeros(grid.shape, int), levels - 1
    height, width = grid.shape
    for y in range(height):
        for x in range(width):
            out[y, x] = min(top, max(0, np.floor(v[y, x] * top + 0.5)))
            e = v[y, x] - out[y, x] / top
            for dx, dy, k in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                if 0 <= x + dx < width and y + dy < height:
                    v[y + dy, x + dx] += e * k / 16
    return out


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (2, 7), (7, 2), (17, 23)])
@pytest.mark.parametrize("levels", [2, 5])
def test_diffusion_equals_a_serial_scan(shape, levels):
    grids = RNG.random((4, *shape))
    assert (pictures.diffused(grids, levels) == np.stack([serial_diffusion(g, levels) for g in grids])).all()


def test_error_diffusion(spark):
    grids = {"a": RNG.random((5, 6)), "b": RNG.random((5, 6)), "c": RNG.random((3, 10)), "d": RNG.random((1, 1))}
    got = {(r.p, r.x, r.y): r.step for r in pictures.error_diffusion(frame(spark, grids), "p", 3).collect()}
    for p, g in grids.items():
        want = serial_diffusion(g, 3)
        assert all(got[p, x, y] == want[y, x] for y in range(g.shape[0]) for x in range(g.shape[1]))
    assert len(got) == 91 and pictures.error_diffusion(frame(spark, grids).limit(0), "p", 2).count() == 0
    with pytest.raises(Exception, match="gaps"):
        pictures.error_diffusion(frame(spark, grids).where("p = 'a' AND NOT (x = 2 AND y = 3)"), "p", 2).count()
    with pytest.raises(ValueError):
        pictures.error_diffusion(frame(spark, grids), "p", 1)


def octree_by_hand(colours, size, depth):
    def cell(c, level):
        return tuple(tuple(v >> (7 - i) & 1 for v in c) for i in range(level))

    nodes = {}
    for c in colours:
        for level in range(depth + 1):
            nodes.setdefault(cell(c, level), []).append(c)
    inner = [k for k in nodes if len(k) < depth]
    children = {k: len({cell(c, len(k) + 1) for c in nodes[k]}) for k in inner}
    split = {k for k in inner if 1 + sum(children[j] - 1 for j in inner if len(nodes[j]) >= len(nodes[k])) <= size}
    leaf = {c: next(cell(c, level) for level in range(depth + 1) if cell(c, level) not in split) for c in set(colours)}
    return {c: tuple(np.mean(nodes[k], axis=0)) for c, k in leaf.items()}


@pytest.mark.parametrize("size", [1, 2, 7, 30, 10_000])
def test_octree(spark, size):
    picked = {"a": [tuple(int(v) for v in c) for c in RNG.integers(0, 256, (60, 3))] * 2, "b": [(10, 20, 30)] * 5 + [(10, 20, 31)], "c": [(0, 0, 0), (255, 255, 255)]}
    rows = [(p, i, *c) for p, cs in picked.items() for i, c in enumerate(cs)]
    colours = spark.createDataFrame(rows, "p string, i int, r int, g int, b int").repartition(3)
    mapped = pictures.octree_mapped(colours, "p", size).collect()
    assert len(mapped) == len(rows)
    for p, cs in picked.items():
        want = octree_by_hand(cs, size, pictures.DEPTH)
        mine = [r for r in mapped if r.p == p]
        assert len({r.slot for r in mine}) <= size and {r.slot for r in mine} == set(range(len({r.slot for r in mine})))
        for r in mine:
            assert (r.pr, r.pg, r.pb) == pytest.approx(want[r.r, r.g, r.b])
