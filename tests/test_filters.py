"""Filters, pictures and meshes against direct computation and round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import filters
from framelake.sources import images, meshes


def stream(spark, values):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "s string, n long, value double").repartition(3)


def values(frame):
    return [r.value for r in frame.orderBy("n").collect()]


def test_noise_gate(spark):
    x = [0.01] * 5 + [0.5] * 10 + [0.01] * 40
    got = values(filters.noise_gate(stream(spark, x), "s", "n", attack=2, hold=3, release=4))
    assert got[:5] == [0.0] * 5 and got[6] == 0.5 and got[15:18] == [0.01] * 3 and got[-1] == 0.0


@pytest.mark.parametrize("feedback", [0.0, 0.5])
def test_echo(spark, feedback):
    x = np.zeros(20)
    x[0] = 1.0
    got = values(filters.echo(stream(spark, x), "s", "n", 4, 0.8, feedback))
    want = np.zeros(20)
    want[0] = 1
    for i, at in enumerate(range(4, 20, 4)):
        want[at] = 0.8 * feedback**i
    assert got == pytest.approx(want.tolist())


def test_biquad(spark):
    t = np.arange(400)
    low, high = np.sin(2 * np.pi * 100 * t / 8000), np.sin(2 * np.pi * 3000 * t / 8000)
    energy = lambda x, kind: np.square(values(filters.biquad(stream(spark, x), "s", "n", kind, 500, 8000))[100:]).sum()
    assert energy(high, "lowpass") < 0.05 * energy(low, "lowpass") and energy(low, "highpass") < 0.05 * energy(high, "highpass")
    with pytest.raises(ValueError):
        filters.biquad_coefficients("comb", 1, 2)


def test_spectrogram(spark):
    x = np.sin(2 * np.pi * 32 * np.arange(512) / 256)
    got = filters.spectrogram(stream(spark, x), "s", "n", 256, 128)
    best = {r.frame: r.bin for r in got.groupBy("frame").agg(F.max_by("bin", "power").alias("bin")).collect()}
    assert best[0] == best[1] == best[2] == 32
    block = np.abs(np.fft.rfft(x[128:384] * np.hanning(256))) ** 2
    assert [r.power for r in got.where("frame = 1").orderBy("bin").collect()] == pytest.approx(block.tolist(), abs=1e-9)


def picture(spark, grid):
    return spark.createDataFrame([("p", x, y, float(v)) for y, row in enumerate(grid) for x, v in enumerate(row)], "p string, x int, y int, value double")


def grid_of(frame, shape):
    out = np.full(shape, np.nan)
    for r in frame.collect():
        out[r.y, r.x] = r.value
    return out


def test_convolution(spark):
    grid = np.arange(30.0).reshape(5, 6) ** 1.5
    padded = np.pad(grid, 1)

    def direct(kernel):
        k = np.array(kernel)
        return sum(k[i, j] * padded[i : i + 5, j : j + 6] for i in range(3) for j in range(3))

    frame = picture(spark, grid)
    assert np.allclose(grid_of(filters.convolve(frame, "p", filters.BOX_BLUR), (5, 6)), direct(filters.BOX_BLUR))
    assert np.allclose(grid_of(filters.edges(frame, "p"), (5, 6)), np.hypot(direct(filters.EDGE_X), direct(filters.EDGE_Y)))


def test_resize_and_chroma(spark):
    grid = np.arange(16.0).reshape(4, 4)
    frame = picture(spark, grid)
    assert np.allclose(grid_of(filters.resize(frame, "p", 4, 4, 4, 4, "bilinear"), (4, 4)), grid)
    assert np.allclose(grid_of(filters.resize(frame, "p", 4, 4, 2, 2, "bilinear"), (2, 2)), [[2.5, 4.5], [10.5, 12.5]])
    assert grid_of(filters.resize(frame, "p", 4, 4, 8, 8), (8, 8)).shape == (8, 8)
    assert np.allclose(grid_of(filters.resample_chroma(frame, "p", 2, 2), (2, 2)), [[2.5, 4.5], [10.5, 12.5]])


@pytest.mark.parametrize("kind", ["nearest", *filters.KERNELS])
def test_resize_joins_nothing(spark, kind):
    """Every kernel against its definition, on a picture with a hole; no side of a join may reach the driver."""
    grid = np.arange(20.0).reshape(4, 5) ** 1.3
    frame = picture(spark, grid).where("x <> 1 OR y <> 2")
    small = filters.resize(frame, "p", 5, 4, 3, 7, kind)
    assert "Join" not in small._jdf.queryExecution().optimizedPlan().toString()
    reach, weight = filters.KERNELS.get(kind, filters.KERNELS["box"])
    for r in small.collect():
        fx, fy = (r.x + 0.5) * (5 / 3) - 0.5, (r.y + 0.5) * (4 / 7) - 0.5
        near = range(1 - reach, reach + 1)
        taps = [(min(max(int(np.floor(fx)) + i, 0), 4), min(max(int(np.floor(fy)) + j, 0), 3), weight(fx - np.floor(fx) - i) * weight(fy - np.floor(fy) - j)) for i in near for j in near]
        taps = [t for t in taps if t[:2] != (1, 2)]
        assert r.value == pytest.approx(sum(grid[y, x] * k for x, y, k in taps) / sum(k for *_, k in taps))


def test_palettes(spark):
    colours = spark.createDataFrame([("p", r, 0, 0) for r in (0, 1, 2, 250, 251, 252)] + [("q", 5, 5, 5)], "p string, r int, g int, b int")
    got = {(r.p, r.r) for r in filters.median_cut(colours, "p", 2).collect()}
    assert got == {("p", 1.0), ("p", 251.0), ("q", 5.0)}
    assert [r[0] for r in spark.createDataFrame([(0.0,), (0.49,), (1.2,)], "v double").select(filters.uniform_palette(F.col("v"), 3)).collect()] == [0, 1, 2]


@pytest.mark.parametrize(("kind", "channels", "dtype"), [("pnm", 3, np.uint8), ("pnm", 1, np.uint16), ("bmp", 3, np.uint8), ("bmp", 4, np.uint8), ("farbfeld", 4, np.uint16), ("qoi", 3, np.uint8), ("qoi", 4, np.uint8)])
def test_picture_round_trips(spark, kind, channels, dtype):
    rng = np.random.default_rng(4)
    p = rng.integers(0, np.iinfo(dtype).max, (9, 7, channels)).astype(dtype)
    p[2:5] = p[2, 0]
    p[5, :, :3] = p[4, :, :3] + np.arange(7)[:, None].astype(dtype)
    data = images.WRITERS[kind](p)
    assert (images.READERS[kind](data) == p).all()
    frame = images.decode(spark.createDataFrame([("u", bytearray(data))], "uri string, data binary"), kind)
    assert bytes(images.encode(frame, kind).first().data) == data


def test_netpbm_text():
    assert images.read_pnm(b"P2\n# note\n2 1\n255\n7 9\n").tolist() == [[[7], [9]]]
    with pytest.raises(ValueError):
        images.read_pnm(b"P9 1 1 1")


CUBE = "\n".join(["v 0 0 0", "v 1 0 0", "v 1 1 0", "v 0 1 0", "usemtl red", "f 1 2 3 4", "usemtl blue", "f 1 2 3"]).encode()


def test_meshes(spark):
    obj = meshes.decode(spark.createDataFrame([("m", bytearray(CUBE))], "uri string, data binary"), "obj")
    assert [(r.material, r.n) for r in obj.groupBy("prim_id", "material").count().orderBy("prim_id").selectExpr("material", "count AS n").collect()] == [("red", 6), ("blue", 3)]
    back = meshes.decode(meshes.encode(obj.repartition(4), "obj"), "obj")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, obj.collect()))
    stl = meshes.decode(meshes.encode(obj, "stl"), "stl")
    assert stl.count() == 9 and {r.material for r in stl.collect()} == {""} and {r.prim_id for r in stl.collect()} == {0}
    text = b"solid a\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid a"
    assert meshes.read_stl(text)[0][1].tolist() == [[[0, 0, 0], [1, 0, 0], [0, 1, 0]]]
    with pytest.raises(meshes.TopologyError):
        meshes.write_stl(np.zeros((2, 4, 3)))
    assert {(r.nx, r.ny, r.nz) for r in meshes.normals(obj).collect()} == {(0.0, 0.0, 1.0)}


def test_sinc_resampling_does_not_depend_on_blocks(spark):
    x = np.sin(2 * np.pi * 50 * np.arange(900) / 3000)
    out = {b: values(filters.resample(stream(spark, x), "s", "n", 3000, 4000, block=b)) for b in (4096, 100)}
    assert len(out[100]) == 1200 and out[100] == pytest.approx(out[4096], abs=1e-12)
    want = np.sin(2 * np.pi * 50 * np.arange(1200) / 4000)
    assert np.abs(np.array(out[100]) - want)[60:-60].max() < 2e-3
    down = values(filters.resample(stream(spark, x), "s", "n", 3000, 1000))
    assert len(down) == 300 and np.abs(np.array(down) - np.sin(2 * np.pi * 50 * np.arange(300) / 1000))[30:-30].max() < 2e-2


def test_morphology_and_tone_maps(spark):
    grid = np.zeros((4, 4))
    grid[1, 2] = 5
    frame = picture(spark, grid)
    assert grid_of(filters.morphology(frame, "p", "dilate"), (4, 4)).sum() == 45 and grid_of(filters.morphology(frame, "p", "erode"), (4, 4)).sum() == 0
    got = spark.range(1).select(filters.tone_map(F.lit(4.0)), filters.tone_map(F.lit(0.0)), filters.tone_map(F.lit(1.0), "gamma")).first()
    assert tuple(got) == pytest.approx((1.0, 0.0, 1.0))


def test_gabor_and_niblack(spark):
    rng = np.random.default_rng(3)
    grid = rng.random((7, 9))
    frame = picture(spark, grid)
    kernel = np.array(filters.gabor(3.0, 0.7, 0.9, 0.2))
    reach = len(kernel) // 2
    padded = np.pad(grid, reach)
    want = sum(kernel[i, j] * padded[i : i + 7, j : j + 9] for i in range(len(kernel)) for j in range(len(kernel)))
    assert np.allclose(grid_of(filters.convolve(frame, "p", kernel.tolist()), (7, 9)), want)
    stripes = np.tile(np.cos(2 * np.pi * np.arange(24) / 4), (24, 1))
    answer = lambda g, theta: np.abs(grid_of(filters.convolve(picture(spark, g), "p", filters.gabor(4.0, theta, 2.0)), (24, 24))[6:18, 6:18]).sum()
    assert answer(stripes, 0.0) > 10 * answer(stripes.T, 0.0) and answer(stripes.T, np.pi / 2) > 10 * answer(stripes, np.pi / 2)
    near = np.full((7, 9), 0.0)
    for y in range(7):
        for x in range(9):
            part = grid[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3]
            near[y, x] = grid[y, x] >= part.mean() + 0.1 * part.std()
    assert (grid_of(filters.niblack(frame, "p", 2, 0.1), (7, 9)) == near).all()
