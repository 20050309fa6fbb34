"""Hierarchies and skinning against plain matrices."""

import math

import numpy as np
import pytest

from framelake.operators import filters, skeleton

RNG = np.random.default_rng(7)


def column_major(m):
    return [float(x) for x in m.T.ravel()]


def nodes_frame(spark, rows):
    return spark.createDataFrame([(k, n, p, column_major(m)) for k, n, p, m in rows], "k string, node int, parent int, matrix array<double>").repartition(2)


def world_by_hand(rows):
    known = {(k, n): (p, m) for k, n, p, m in rows}

    def world(k, n):
        p, m = known[k, n]
        return world(k, p) @ m if (k, p) in known else m

    return {key: world(*key) for key in known}


@pytest.mark.parametrize("rounds", [None, 5])
def test_world_matrices(spark, rounds):
    """A chain of twenty, a tree, a lone root, a parent that is not there."""
    matrices = lambda n: [np.vstack([RNG.normal(size=(3, 4)) * 0.7, [0, 0, 0, 1]]) for _ in range(n)]
    rows = [("chain", i, i - 1 if i else None, m) for i, m in enumerate(matrices(20))]
    rows += [("tree", i, (i - 1) // 2 if i else None, m) for i, m in enumerate(matrices(15))]
    rows += [("one", 0, None, matrices(1)[0]), ("lost", 3, 99, matrices(1)[0])]
    got = {(r.k, r.node): np.array(r.world).reshape(4, 4).T for r in skeleton.world_matrices(nodes_frame(spark, rows), "k", rounds).collect()}
    want = world_by_hand(rows)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_cycles(spark, monkeypatch):
    monkeypatch.setattr(skeleton, "ROUNDS", 3)
    with pytest.raises(ValueError, match="cycle"):
        skeleton.world_matrices(nodes_frame(spark, [("a", 0, 1, np.eye(4)), ("a", 1, 0, np.eye(4))]), "k")


def test_weights_are_repaired(spark):
    nan = float("nan")
    rows = [(0, 1, 2.0), (0, 2, 6.0), (1, 1, -1.0), (1, 2, 4.0), (2, 5, 0.0), (2, 3, nan), (3, 1, None), (3, 4, 1.0), (4, 7, 1.0), (4, 7, 1.0)]
    got = {(r.v, r.joint): r.weight for r in skeleton.repaired_weights(spark.createDataFrame(rows, "v int, joint int, weight double"), ["v"]).collect()}
    assert got == {(0, 1): 0.25, (0, 2): 0.75, (1, 2): 1.0, (2, 3): 1.0, (3, 4): 1.0, (4, 7): 1.0}


def test_skinning(spark):
    move = lambda *t: np.block([[np.eye(3), np.array([t]).T], [np.zeros((1, 3)), np.ones((1, 1))]])
    turn = np.array([[0.0, -1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    joints = spark.createDataFrame([("m", 0, column_major(move(1, 2, 3)), column_major(np.eye(4))), ("m", 1, column_major(turn), column_major(move(-1, 0, 0)))], "k string, node int, world array<double>, inverse array<double>")
    vertices = spark.createDataFrame([("m", i, 2.0, 0.0, 0.0) for i in range(4)], "k string, v int, x double, y double, z double")
    influences = spark.createDataFrame([("m", 0, 0, 1.0), ("m", 1, 1, 5.0), ("m", 2, 0, 1.0), ("m", 2, 1, 1.0)], "k string, v int, joint int, weight double")
    got = {r.v: (r.x, r.y, r.z) for r in skeleton.skinned(vertices, influences, joints, "k", "v").collect()}
    assert got == {0: (3, 2, 3), 1: pytest.approx((0, 1, 0)), 2: pytest.approx((1.5, 1.5, 1.5)), 3: (2, 0, 0)}


@pytest.mark.parametrize("block", [4096, 32, 5])
def test_true_peaks(spark, block):
    """A tone between samples is higher than at any of them; blocks agree with one reading."""
    n = np.arange(160)
    x = {"a": np.sin(2 * np.pi * n / 4 + np.pi / 4), "b": RNG.normal(size=61), "c": np.array([0.5])}
    rows = [(k, 7 * i + 3, float(v)) for k, values in x.items() for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "k string, n long, value double").repartition(3)
    got = filters.true_peaks(frame, "k", "n", block).collect()
    assert len(got) == sum(math.ceil(len(v) / block) for v in x.values())
    taps, _, _ = filters.sinc_taps(1, 4, 12)
    for k, values in x.items():
        padded = np.pad(values, (11, 12))
        y = np.abs(np.stack([padded[i : i + 24] @ taps.T for i in range(len(values))]))
        for r in (r for r in got if r.k == k):
            part = slice(r.block * block, (r.block + 1) * block)
            assert r.true_peak == pytest.approx(y[part].max()) and r.sample_peak == np.abs(values[part]).max()
    whole = max(r.true_peak for r in got if r.k == "a")
    assert whole > 0.98 and max(r.sample_peak for r in got if r.k == "a") < 0.71
