"""Structured Streaming forms of the time operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def profile(events: DataFrame, time: str, section: str, value: str, width: str = "1 second", lateness: str = "100 milliseconds") -> DataFrame:
    """Count, mean and worst value per section in tumbling windows; rows later than the watermark are dropped."""
    grouped = events.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), section)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("worst")).select(F.col("w.start").alias("start"), section, "n", "mean", "worst")


def idle_sessions(events: DataFrame, time: str, key: str, gap: str = "3 seconds", lateness: str = "100 milliseconds") -> DataFrame:
    """Sessions of a key that a pause of ``gap`` ends."""
    grouped = events.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, time: str, keys: list[str], lateness: str = "10 minutes") -> DataFrame:
    """Repeated keys once, within the watermark."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


class SeekMachine(StatefulProcessor):
    """Presents the frames of one session in the order of (ts, seq), whatever order they come in.

    Messages wait in a map until the watermark passes them; the earliest one holds a
    timer.  When a session has nothing left and was idle for ``idle_ms``, a second timer
    clears its state.  Messages older than the watermark are dropped.
    """

    def __init__(self, key: str, idle_ms: int):
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long, seq long", "kind string, generation long, pts long")
        self.machine = handle.getValueState("machine", "pending long, anchor long, seen_ms long")

    def _timer(self, ms: int) -> None:
        """The session's only timer."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        self.handle.registerTimer(ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        pending, anchor, seen = self.machine.get() if self.machine.exists() else (-1, 0, 0)
        first = None
        for row in rows:
            ms = int(row.ts.timestamp() * 1000)
            if ms > mark:
                self.waiting.updateValue((ms, row.seq), (row.kind, row.generation, row.pts))
                seen = max(seen, ms)
                first = ms if first is None else min(first, ms)
        if first is not None:
            self.machine.update((pending, anchor, seen))
            known = [ms for ms, _ in self.waiting.keys()]
            self._timer(min(known))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        pending, anchor, seen = self.machine.get() if self.machine.exists() else (-1, 0, 0)
        due = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] <= mark)
        out = []
        for (ms, seq), (kind, generation, pts) in due:
            if kind == "request":
                pending = generation
            elif kind == "barrier" and generation == pending:
                pending, anchor = -1, pts
            elif kind == "rejected" and generation == pending:
                pending = -1
            elif kind == "frame" and pending < 0:
                out.append(Row(**{self.key: key[0], "seq": seq, "pts": pts, "anchor": anchor}))
            self.waiting.removeKey((ms, seq))
        left = [ms for ms, _ in self.waiting.keys()]
        if left:
            self.machine.update((pending, anchor, seen))
            self._timer(min(left))
        elif seen + self.idle_ms > mark:
            self.machine.update((pending, anchor, seen))
            self._timer(seen + self.idle_ms)
        else:
            self.machine.clear()
            self.waiting.clear()
        return iter(out)

    def close(self) -> None: ...


def seek_filter(messages: DataFrame, key: str = "session", lateness: str = "5 seconds", idle_ms: int = 60_000) -> DataFrame:
    """The seek state machine over (session, ts, seq long, kind, generation long, pts long): what is presented.

    A request makes its generation pending; frames are discarded until the barrier
    of the latest generation arrives, which re-anchors the clock at its pts; a
    rejection drops the request.  Messages take effect in the order of (ts, seq) once
    the watermark has passed them, so that micro-batches may bring them in any order;
    the state of a session that was idle for ``idle_ms`` is gone.  Needs the RocksDB
    state store.
    """
    marked = messages.withWatermark("ts", lateness)
    return marked.groupBy(key).transformWithState(SeekMachine(key, idle_ms), f"{key} string, seq long, pts long, anchor long", "append", "EventTime")


def start_faults(messages: DataFrame, by: str, ts: str, order: str, kind: str, deadline: float = 30.0) -> DataFrame:
    """(by, fault): what is wrong with the start of a session, null if nothing is.

    The first message should be "started" (finished early, out of order), and no later
    than ``deadline`` seconds after the session opened with "opened" (late).
    """
    place = F.struct(ts, order)
    first = lambda what: F.min(F.when(what, place))
    rows = messages.groupBy(by).agg(first(F.col(kind) == "opened").alias("_open"), first(F.col(kind) == "started").alias("_start"), F.min_by(kind, F.when(F.col(kind) != "opened", place)).alias("_first"))
    late = F.unix_micros(F.col("_start")[ts].cast("timestamp")) - F.unix_micros(F.col("_open")[ts].cast("timestamp")) > deadline * 1e6
    fault = F.when(F.col("_start").isNull(), "never started").when(F.col("_first") == "finished", "finished early").when(F.col("_first") != "started", "out of order").when(late, "late")
    return rows.select(by, fault.alias("fault"))


class Sink:
    """start, write and finish over micro-batches; an error in one stops the query."""

    def start(self, columns: list[str]) -> None: ...

    def write(self, batch: DataFrame, batch_id: int) -> None:
        raise NotImplementedError

    def finish(self) -> None: ...


def run_into(stream: DataFrame, sink: Sink, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs everything available into the sink and finishes it."""
    sink.start(stream.columns)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink.write).start()
    query.awaitTermination()
    sink.finish()
    return query


def collect_into(rows: list) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for tests."""
    return lambda batch, _: rows.extend(batch.collect())
