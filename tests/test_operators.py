"""Registry and timeline operators on small hand-made rows."""

import pytest

from framelake.operators import registry, timeline


def test_checked_options(spark):
    schema = spark.createDataFrame([("a", "q", "u32", None, "5"), ("a", "mode", "enum", ["x", "y"], "x"), ("a", "gain", "f32", None, "0"), ("a", "on", "bool", None, "true")], "codec string, name string, kind string, variants array<string>, default string")
    given = spark.createDataFrame([("a", "q", "-1"), ("a", "mode", "y"), ("a", "gain", "1.5e3"), ("a", "zz", "1")], "codec string, name string, value string")
    got = {r.name: (r.value, r.problem) for r in registry.checked_options(given, schema).collect()}
    assert got == {"q": ("-1", "not a u32"), "mode": ("y", None), "gain": ("1.5e3", None), "on": ("true", None), "zz": ("1", "unknown option")}


def test_stale_probes(spark):
    cols = "path string, mtime long, size long"
    got = registry.stale_probes(spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], cols), spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], cols))
    assert [r.path for r in got.collect()] == ["b"]


def test_flattened_nodes(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "node int, parent int")
    assert {tuple(r) for r in registry.flattened_nodes(nodes).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0)}
    with pytest.raises(ValueError):
        registry.flattened_nodes(nodes, most_depth=1)


def test_fill_gaps(spark):
    rows = spark.createDataFrame([("s", 0, "a"), ("s", 960, "b"), ("s", 3840, "c")], "s string, pts long, data string")
    got = [(r.pts, r.data, r.concealed) for r in timeline.fill_gaps(rows, "s", "pts", 960).orderBy("pts").collect()]
    assert got == [(0, "a", False), (960, "b", False), (1920, None, True), (2880, None, True), (3840, "c", False)]


def test_unwrap_passes_two_wraps(spark):
    true = [2**33 - 10 + i * 2**31 for i in range(12)]
    rows = spark.createDataFrame([("s", i, t % 2**33) for i, t in enumerate(true)], "s string, n long, pts long")
    assert [r.unwrapped for r in timeline.unwrap(rows, "s", "n", "pts").orderBy("n").collect()] == true


def test_seek_epochs_ignore_stale_barriers(spark):
    events = [(0, None, None), (1, 1, None), (2, None, None), (3, 2, None), (4, None, 1), (5, None, 2), (6, None, None)]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("s", *e) for e in events], "s string, n int, ask int, got int")
    out = timeline.seek_epochs(rows, "s", "n", F.col("ask"), F.col("got")).orderBy("n").collect()
    assert [r.pending for r in out] == [False, True, True, True, True, False, False] and [r.epoch for r in out] == [0, 0, 0, 0, 0, 2, 2]


def test_correlation_of_constant_and_short_windows(spark):
    from pyspark.sql import Window

    from framelake.operators import metrics

    rows = [(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 4.0, 5.0), (4, 4.0, 6.0), (5, 4.0, 7.0), (6, 5.0, 8.0)]
    frame = spark.createDataFrame(rows, "n int, a double, b double")
    found = frame.select("n", metrics.correlation("a", "b", Window.orderBy("n").rowsBetween(-1, 0)).alias("two"), metrics.correlation("a", "b", Window.orderBy("n").rowsBetween(-2, 0)).alias("three")).orderBy("n").collect()
    assert [r.two for r in found] == [None, None, None, None, None, pytest.approx(1.0)]
    assert [r.three for r in found][:5] == [None, None, None, pytest.approx(0.5), None]
    assert found[5].three == pytest.approx(3**0.5 / 2)


def test_cheapest_paths(spark):
    """Against a plain search over random relations, with ties, two parts and loops."""
    import random

    from framelake.operators import paths

    rng = random.Random(1)
    edges = [(a, b, rng.randint(1, 9)) for a in "abcdefg" for b in "abcdefg" if rng.random() < 0.3] + [("x", "y", 2), ("y", "x", 2), ("x", "x", 1), ("x", "y", 5)]
    best = {(n, n): (0, 1, [n]) for a, b, _ in edges if a != b for n in (a, b)}
    changed = True
    while changed:
        changed = False
        for (a, b), (cost, _, path) in list(best.items()):
            for c, d, more in edges:
                found = (cost + more, len(path) + 1, [*path, d])
                if c == b and d not in path and found < best.get((a, d), (10**9,)):
                    best[a, d], changed = found, True
    got = {(r.a, r.b): (r.cost, len(r.path), r.path) for r in paths.cheapest_paths(spark.createDataFrame(edges, "a string, b string, cost long"), 3).collect()}
    assert got == best


def test_extras_through_formats(spark):
    from framelake.operators import extras
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, {"position": "[1,2]", "extras": '{"a": {"b": [1, null]}}'}), (2, {"material": '"red"'}), (3, {}), (4, None)], "id int, a map<string, string>")
    elements = rows.select("id", F.transform_values("a", lambda _, v: F.parse_json(v)).alias("attributes"))
    assert {(r.sink, r.attribute): (r.kept, r.dropped) for r in extras.losses(elements, ("stl", "gltf")).collect()} == {("stl", "position"): (1, 0), ("stl", "material"): (0, 1), ("stl", "extras"): (0, 1), ("gltf", "position"): (1, 0), ("gltf", "material"): (1, 0), ("gltf", "extras"): (1, 0)}
    kept = {r.id: r.j for r in extras.through(elements, "gltf").select("id", F.transform_values("attributes", lambda _, v: F.to_json(v)).alias("j")).collect()}
    assert kept == {1: {"position": "[1,2]", "extras": '{"a":{"b":[1,null]}}'}, 2: {"material": '"red"'}, 3: {}, 4: None}
    assert extras.through(elements, "stl").where("id = 1").select(F.map_keys("attributes")).first()[0] == ["position"]
