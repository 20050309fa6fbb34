"""Results whose rows are many and alike: what they hold, and how small they are stored."""

import random
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

from framelake.operators import timeline
from framelake.queries import ORACLES, QUERIES


def stored(df, folder) -> float:
    """Bytes a row of a DataFrame in one Parquet file."""
    df.write.parquet(str(folder))
    files = list(Path(folder).glob("*.parquet"))
    rows = sum(duckdb.sql(f"SELECT count(*) FROM '{f}'").fetchall()[0][0] for f in files)
    return sum(f.stat().st_size for f in files) / rows


def test_filled_gaps_are_stored_small(spark, tmp_path):
    rows = spark.createDataFrame([(s, t, 1.0) for s in range(96) for t in (s, 900 + 7 * s, 3_000)], "s long, t long, v double").coalesce(1)
    assert stored(timeline.fill_gaps(rows, "s", "t", 1).coalesce(1), tmp_path / "out") < 1


def test_gaps_are_cut_without_loss(spark):
    rng = random.Random(5)
    given = {s: sorted(rng.sample(range(-40, 400), 7)) for s in range(5)} | {9: [0, 3, 6, 60], 10: [-1]}
    rows = spark.createDataFrame([(s, t, float(t)) for s, ts in given.items() for t in ts], "s long, t long, v double")
    for step, run in ((1, 4), (3, 4), (5, 1), (1, 1440)):
        expected = []
        for s, ts in given.items():
            for t, ahead in zip(ts, [*ts[1:], ts[-1] + step]):
                expected += [(s, at, float(t) if at == t else None, at != t) for at in range(t, max(ahead - 1, t) + 1, step)]
        assert sorted((tuple(r) for r in timeline.fill_gaps(rows, "s", "t", step, run).collect()), key=str) == sorted(expected, key=str)


def _purchases(spark, folder, values, suppliers):
    rows = [(i, datetime(2024, 1, 1), 1, "view" if i % 10 == 9 else "purchase", v, "{}") for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(k,) for k in range(suppliers)], "s_suppkey long").coalesce(1).write.parquet(f"{folder}/supplier.parquet")


def test_pairs_in_range_are_stored_small(spark, tmp_path):
    rng = random.Random(7)
    _purchases(spark, tmp_path, [rng.uniform(0, 100) for _ in range(6000)], 2000)
    assert stored(QUERIES["interval_join"](spark, str(tmp_path)).coalesce(1), tmp_path / "out") < 0.5


def test_pairs_at_the_edges_of_ranges(spark, tmp_path):
    _purchases(spark, tmp_path, [0.0, -0.0, 1.0, 1.999, 2.0, -1e-20, -3.0, 99.5, 100.999, 101.0, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), None, 50.25], 250)
    connection = duckdb.connect()
    for name in ("events", "supplier"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["interval_join"](spark, str(tmp_path)).collect())
    assert got and got == sorted(connection.sql(ORACLES["interval_join"]).fetchall())


def test_convert_command_joins_nothing(spark, tmp_path):
    """A join of pixels with taps once held most of a task's memory."""
    spark.createDataFrame([(i, [0.01 * k for k in range(64)], 0) for i in range(3)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["convert_command"](spark, str(tmp_path))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 48


def shuffled(df) -> list[int]:
    """Runs a DataFrame; the rows that each of its exchanges wrote."""

    def below(node):
        name = node.nodeName()
        if name == "Exchange":
            yield node.metrics().apply("shuffleRecordsWritten").value()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
        for each in inner:
            yield from below(each)

    df.collect()
    return list(below(df._jdf.queryExecution().executedPlan()))


def test_convert_command_sums_nothing_beyond_its_pictures(spark, tmp_path):
    """Sums for places outside the pictures once were more than half of the rows that a task held."""
    spark.createDataFrame([(i, [0.01 * k for k in range(64)], 0) for i in range(3)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert shuffled(QUERIES["convert_command"](spark, str(tmp_path))) == [3 * 16] * 4


@pytest.mark.parametrize("name", ["resize_box", "resize_hermite"])
def test_resizes_send_nothing_to_the_driver(spark, tmp_path, name):
    """All pixels once went through the driver, as the small side of a join."""
    rng = random.Random(3)
    spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(64)], 0) for i in range(20)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    got = {tuple(r)[:3]: r.value for r in out.collect()}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {tuple(r[:3]): r[3] for r in connection.sql(ORACLES[name]).fetchall()}
    assert len(want) == 20 * 30 and got == pytest.approx(want, abs=1.1e-4)
