"""Structured Streaming forms against their batch meaning."""

import datetime as dt

import pytest

from framelake.streaming import stateful


@pytest.fixture()
def source(spark, tmp_path):
    def make(frame, parts=1):
        frame.repartition(parts).write.parquet(str(tmp_path / "in"))
        return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return make


def test_profile(spark, source, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(milliseconds=300 * i), "a" if i % 2 else "b", float(i)) for i in range(40)]
    frame = spark.createDataFrame(rows, "ts timestamp, section string, value double")
    out = []
    query = stateful.profile(source(frame), "ts", "section", "value").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(stateful.collect_into(out)).start()
    query.awaitTermination()
    want = {}
    for ts, section, value in rows:
        want.setdefault((ts.replace(microsecond=0), section), []).append(value)
    assert out and all(want[(r.start, r.section)] == pytest.approx([r.mean] * r.n, abs=9) and r.worst == max(want[(r.start, r.section)]) and r.n == len(want[(r.start, r.section)]) for r in out)


T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
MESSAGES = "session string, ts timestamp, seq long, kind string, generation long, pts long"


def presented(spark, tmp_path, batches, **options):
    """Runs micro-batches, one file each, and gives what was presented and the query's last progress."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(str(folder / f"b={i}"))
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    out = []
    query = stateful.seek_filter(stream, **options).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(stateful.collect_into(out)).start()
    query.awaitTermination()
    return sorted((r.session, r.seq, r.pts, r.anchor) for r in out), query.lastProgress


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_seek_filter(spark, tmp_path):
    kinds = [("frame", 0, 1), ("request", 1, 0), ("frame", 0, 2), ("barrier", 0, 7), ("barrier", 1, 50), ("frame", 0, 51), ("request", 2, 0), ("rejected", 2, 0), ("frame", 0, 52)]
    rows = [("s", at(i), i, *k) for i, k in enumerate(kinds)]
    got, _ = presented(spark, tmp_path, [rows, [("z", at(1000), 0, "request", 9, 0)]])
    assert got == [("s", 0, 1, 0), ("s", 5, 51, 50), ("s", 8, 52, 50)]


def test_shuffled_batches_equal_the_batch_form(spark, tmp_path):
    """Messages up to four seconds out of order, cut into micro-batches, against seek_epochs; late ones are dropped, idle sessions forgotten."""
    import random

    from pyspark.sql import functions as F

    from framelake.operators import timeline

    rng, rows = random.Random(5), []
    for session in "abc":
        generation = 0
        for i in range(60):
            kind = rng.choices(["frame", "request", "barrier", "stale"], [6, 1, 1, 1])[0]
            generation += kind == "request"
            answer = {"request": generation, "barrier": generation, "stale": max(0, generation - 1)}.get(kind, 0)
            rows.append((session, at(i * 0.5), i, "barrier" if kind == "stale" else kind, answer, i * 10))
    arriving = sorted(rows, key=lambda r: (r[1] + dt.timedelta(seconds=rng.uniform(0, 4)), r[0]))
    batches = [arriving[i : i + 45] for i in range(0, len(arriving), 45)]
    far = [[("z", at(500), 0, "request", 1, 0)], [("a", at(1), 999, "frame", 0, 0), ("z", at(900), 1, "frame", 0, 0)]]
    got, progress = presented(spark, tmp_path, batches + far, idle_ms=10_000)
    frame = spark.createDataFrame(rows, MESSAGES)
    asked, answered = (F.when(F.col("kind") == k, F.col("generation")) for k in ("request", "barrier"))
    want = timeline.seek_epochs(frame, "session", "seq", asked, answered).where("kind = 'frame' AND NOT pending").select("session", "seq", "pts").collect()
    assert sorted((s, q, p) for s, q, p, _ in got) == sorted(map(tuple, want)) and len(want) > 20
    # of four sessions only z, which may still get messages, has state: its machine, its waiting message and a timer
    assert progress["stateOperators"][0]["numRowsTotal"] <= 4


def test_start_faults(spark):
    rows = [("ok", 0, "opened"), ("ok", 5, "started"), ("ok", 6, "finished"), ("late", 0, "opened"), ("late", 31, "started"), ("early", 0, "finished"), ("early", 1, "started"), ("never", 0, "frame"), ("mixed", 0, "frame"), ("mixed", 1, "started"), ("bare", 0, "started")]
    frame = spark.createDataFrame([(k, at(t), i, kind) for i, (k, t, kind) in enumerate(rows)], "k string, ts timestamp, n long, kind string")
    assert {r.k: r.fault for r in stateful.start_faults(frame, "k", "ts", "n", "kind").collect()} == {"ok": None, "late": "late", "early": "finished early", "never": "never started", "mixed": "out of order", "bare": None}


def test_sink_contract(spark, source, tmp_path):
    class Counting(stateful.Sink):
        rows, started, finished = 0, None, False

        def start(self, columns):
            self.started = columns

        def write(self, batch, batch_id):
            self.rows += batch.count()

        def finish(self):
            self.finished = True

    sink = Counting()
    stateful.run_into(source(spark.range(10).toDF("n"), 3), sink, str(tmp_path / "c"))
    assert (sink.rows, sink.started, sink.finished) == (10, ["n"], True)

    class Failing(stateful.Sink):
        def write(self, batch, batch_id):
            raise RuntimeError("sink is full")

    with pytest.raises(Exception, match="sink is full"):
        stateful.run_into(spark.readStream.schema("n long").parquet(str(tmp_path / "in")), Failing(), str(tmp_path / "d"))


def test_first_seen_and_sessions_plan(spark, source):
    frame = spark.createDataFrame([(dt.datetime(2024, 1, 1), "k")], "ts timestamp, key string")
    stream = source(frame)
    assert stateful.first_seen(stream, "ts", ["key"]).isStreaming and stateful.idle_sessions(stream, "ts", "key").columns == ["key", "start", "end", "n"]
