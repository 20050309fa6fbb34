"""Queries that once read a subset of ids, on small tables with ids beyond it."""

import random
from datetime import datetime

from framelake.queries import QUERIES


def test_loss_concealment_fills_every_user(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, 0, minute), user, "view", float(minute), "{}") for i, (user, minute) in enumerate([(3, 0), (3, 2), (20, 5), (20, 5), (20, 8), (1499, 1)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    first = 1704067200 // 60
    got = sorted((r.user_id, r.slot - first, r.value, r.concealed) for r in QUERIES["loss_concealment"](spark, str(tmp_path)).collect())
    assert got == [(3, 0, 0.0, False), (3, 1, None, True), (3, 2, 2.0, False), (20, 5, 5.0, False), (20, 6, None, True), (20, 7, None, True), (20, 8, 8.0, False), (1499, 1, 1.0, False)]


def test_best_lag_covers_every_frame(spark, tmp_path):
    rng = random.Random(3)
    long = [rng.uniform(-1, 1) for _ in range(64 + 8)]
    lags = {0: 2, 99: 5, 100: 3, 2500: 8}
    rows = [(at, long[:64], 0) for at in lags] + [(at + 1, long[lag : lag + 64], 0) for at, lag in lags.items() if at != 99]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.lag, r.rms) for r in QUERIES["best_lag"](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 99, 100, 2500} and all(got[at] == (lag, 0.0) for at, lag in lags.items() if at != 99)


def test_box_levels_are_rounded_in_single_precision(spark, tmp_path):
    """Values a little below a half in double precision, and at it in the table's own."""
    import duckdb

    from framelake.queries import ORACLES

    rows = [(i, [(2 * (i * 64 + k) + 1) / 2000 for k in range(64)], 0) for i in range(8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["box_downsample"](spark, str(tmp_path)).select("vec_id", "bx", "by", "v").collect())
    assert got == sorted(connection.sql(f'SELECT vec_id, bx, "by", v FROM ({ORACLES["box_downsample"]})').fetchall())
