"""Running aggregates in blocks against whole windows, and the comparison of routes."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.operators import blocked
from framelake.operators.metrics import parity
from framelake.operators.streams import number


def rows_of(spark, n=600):
    rng = random.Random(1)
    at = sorted(rng.sample(range(-500, 5000), n // 2))
    rows = [(rng.choice(["a", "b", None]), t, i, rng.choice([None, rng.randint(-9, 9)])) for i, t in enumerate(at + at)]
    return spark.createDataFrame(rows, "s string, t long, tie long, v long").repartition(5)


def test_every_kind_in_blocks(spark):
    rows = rows_of(spark)
    kinds = {"count": ("count", F.lit(1)), "total": ("sum", F.col("v")), "top": ("max_before", F.col("v")), "low": ("min", F.col("v")), "last": ("last", F.col("v")), "old": ("last_before", F.col("v")), "lag": ("lag", F.col("v")), "n": ("count_before", F.lit(1))}
    order = Window.partitionBy("s").orderBy("t", "tie")
    here, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumns({
        "count": F.count(F.lit(1)).over(here), "total": F.sum("v").over(here), "top": F.max("v").over(before), "low": F.min("v").over(here), "last": F.last("v", True).over(here),
        "old": F.last("v", True).over(before), "lag": F.lag("v").over(order), "n": F.count(F.lit(1)).over(before),
    })
    want = sorted(map(str, want.collect()))
    for width in (3, 70, 10_000):
        got = blocked.running(rows, "s", ["t", "tie"], width, **kinds)
        assert got.columns == ["s", "t", "tie", "v", *kinds]
        assert sorted(map(str, got.collect())) == want
    assert blocked.running(rows.where("false"), "s", "t", 5, n=("count", F.lit(1))).count() == 0


def test_halo(spark):
    numbered = number(rows_of(spark), "s", ["t", "tie"], width=50.0)
    order = Window.partitionBy("s", "_block").orderBy("n")
    for width in (5, 64):
        got = blocked.with_halo(numbered, "n", 4, width).withColumn("sum", F.sum("v").over(order.rowsBetween(-4, 0))).where("_own")
        want = numbered.withColumn("sum", F.sum("v").over(Window.partitionBy("s").orderBy("n").rowsBetween(-4, 0)))
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_parity_shows_a_planted_difference(spark):
    rows = [("a", i, i / 2) for i in range(10)] + [("b", i, 1.0) for i in range(5)]
    direct = spark.createDataFrame(rows, "s string, n long, value double")
    changed = spark.createDataFrame([("a", 3, 9.0) if r[:2] == ("a", 3) else r for r in rows if r != ("b", 4, 1.0)] + [("b", 1, 1.0)], "s string, n long, value double")
    same = {r.s: (r.n, r.only_direct, r.only_job) for r in parity(direct, direct.repartition(3), "s", "value").collect()}
    assert same == {"a": (10, 0, 0), "b": (5, 0, 0)}
    assert {r.s: (r.n, r.only_direct, r.only_job) for r in parity(direct, changed, "s", "value").collect()} == {"a": (10, 1, 1), "b": (5, 1, 1)}


def test_digest_in_batches(spark):
    from framelake.functions.digest import audio_frame_parts, fnv1a, stream_digests

    rows = [(f"s{i % 3}", i, None if i % 5 == 0 else i * 7, None if i % 11 == 0 else bytes([i % 256]) * (i % 9)) for i in range(400)]
    frame = spark.createDataFrame(rows, "s string, n long, pts long, payload binary").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r.s: (r.frames, r.digest) for r in stream_digests(frame, "s", "n").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in ("s0", "s1", "s2"):
        mine = [r for r in rows if r[0] == s]
        assert got[s] == (len(mine), f"{fnv1a(part for r in mine for part in audio_frame_parts(r[2], 1, [r[3] or b''])):016x}")
