"""Windows, as-of joins, sessions and cues on the time axis."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import tables
from ..operators import blocked
from ..operators import timeline as op
from ..operators.streams import number
from ..streaming import stateful
from .registrar import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

_P = "p AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS pts, value FROM events)"


@query(f"""
WITH {_P}, m AS (SELECT user_id, pts, max(value) AS value FROM p WHERE event_type = 'view' GROUP BY 1, 2)
SELECT v.user_id, v.event_id, v.pts, (SELECT arg_max(m.value, m.pts) FROM m WHERE m.user_id = v.user_id AND m.pts <= v.pts + 2000) AS clock FROM p v WHERE v.event_type = 'click'""")
def av_pacing(spark, sf_dir):
    """The audio clock that each video frame is held against, with 2 ms of slack."""
    p = tables.packets(spark, sf_dir)
    clock = p.where("stream_key = 'view'").groupBy("asset_id", "pts").agg(F.max("value").alias("clock"))
    frames = p.where("stream_key = 'click'").select("asset_id", "pts", F.col("ordinal").alias("event_id"))
    return op.as_of(frames, clock, "asset_id", "pts", "clock", slack=2000).withColumnRenamed("asset_id", "user_id")


@query(f"""
WITH {_P} SELECT event_id, pts, coalesce(pts + 100000 < max(pts) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM p""")
def late_drop(spark, sf_dir):
    return op.late_rows(tables.packets(spark, sf_dir), "stream_key", "ordinal", "pts", 100_000).select(F.col("ordinal").alias("event_id"), "pts", "late")


@query("""
WITH e AS (SELECT event_id, event_type, user_id, strlen(props) AS n, event_id % 97 = 0 AS seek FROM events),
x AS (SELECT *, sum(CASE WHEN seek THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM e)
SELECT event_id, epoch::BIGINT AS epoch, (sum(n) OVER w)::BIGINT AS buffered, max(sum_ok) OVER w AS started FROM (
  SELECT *, (sum(n) OVER (PARTITION BY event_type, epoch ORDER BY event_id ROWS UNBOUNDED PRECEDING)) >= 100 AS sum_ok FROM x)
WINDOW w AS (PARTITION BY event_type, epoch ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def audio_end_running(spark, sf_dir):
    """Running end of the audio, restarted at each seek, and the preroll latch."""
    p = tables.packets(spark, sf_dir)
    p = blocked.running(p, "stream_key", "ordinal", blocked.ORDINALS, epoch=("sum", (F.col("ordinal") % 97 == 0).cast("long")))
    w = op.running(["stream_key", "epoch"], "ordinal")
    p = p.withColumn("buffered", F.sum("size").over(w))
    return p.select(F.col("ordinal").alias("event_id"), "epoch", "buffered", F.max(F.col("buffered") >= 100).over(w).alias("started"))


@query(f"""
WITH {_P} SELECT event_id, pts - last_value(CASE WHEN event_type = 'view' THEN pts END IGNORE NULLS) OVER w AS audio_drift, pts - last_value(CASE WHEN event_type = 'click' THEN pts END IGNORE NULLS) OVER w AS video_drift
FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pts, event_id ROWS UNBOUNDED PRECEDING)""")
def drift_snapshot(spark, sf_dir):
    w = op.running("asset_id", "pts", "ordinal")
    last = lambda kind: F.last(F.when(F.col("stream_key") == kind, F.col("pts")), ignorenulls=True).over(w)
    return tables.packets(spark, sf_dir).select(F.col("ordinal").alias("event_id"), (F.col("pts") - last("view")).alias("audio_drift"), (F.col("pts") - last("click")).alias("video_drift"))


@query("""
SELECT date_trunc('hour', ts) AS start, event_type AS section, count(*)::BIGINT AS n, round(max(value), 6) AS worst, round(sum(value) / greatest(count(*), 1), 6) AS mean FROM events GROUP BY 1, 2""")
def tumbling_profile(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    grouped = e.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("section"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("worst"), F.round(F.sum("value") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("mean")).select(F.col("w.start").alias("start"), "section", "n", "worst", "mean")


@query(f"""
WITH {_P}, f AS (SELECT *, CASE WHEN pts - lag(pts) OVER w > 3600000000 OR lag(pts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY pts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, min(pts) AS first_pts, max(pts) AS last_pts FROM s GROUP BY 1, 2""")
def session_idle(spark, sf_dir):
    s = op.sessions(tables.packets(spark, sf_dir), "asset_id", "pts", 3_600_000_000, "ordinal")
    return s.groupBy(F.col("asset_id").alias("user_id"), "session").agg(F.count(F.lit(1)).alias("n"), F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"))


@query("""
WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 50 = 7 THEN event_id // 50 + 1 END AS request, CASE WHEN event_id % 50 = 20 THEN event_id // 50 + 1 END AS answer FROM events),
a AS (SELECT *, max(request) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS asked FROM e),
b AS (SELECT *, max(CASE WHEN answer = asked THEN answer END) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS answered FROM a)
SELECT event_id, coalesce(asked > coalesce(answered, -1), false) AS pending, coalesce(answered, 0)::BIGINT AS epoch FROM b""")
def seek_epochs(spark, sf_dir):
    generation = (F.floor(F.col("ordinal") / 50) + 1).cast("long")
    request, answer = F.when(F.col("ordinal") % 50 == 7, generation), F.when(F.col("ordinal") % 50 == 20, generation)
    return op.seek_epochs(tables.packets(spark, sf_dir), "stream_key", "ordinal", request, answer).select(F.col("ordinal").alias("event_id"), "pending", "epoch")


@query(f"""
WITH {_P}, w AS (SELECT event_id, event_type, pts // 1000 AS t, (pts // 1000) % 8589934592 AS wrapped FROM p),
d AS (SELECT *, wrapped - lag(wrapped) OVER (PARTITION BY event_type ORDER BY t, event_id) AS step FROM w)
SELECT event_id, wrapped, (wrapped + sum(CASE WHEN step < -4294967296 THEN 8589934592 WHEN step > 4294967296 THEN -8589934592 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS unwrapped FROM d""")
def pts_unwrap(spark, sf_dir):
    p = tables.packets(spark, sf_dir).withColumn("t", F.expr("pts div 1000")).withColumn("wrapped", F.col("t") % 8589934592)
    return op.unwrap(p, "stream_key", ["t", "ordinal"], "wrapped", width=blocked.MICROS // 1000).select(F.col("ordinal").alias("event_id"), "wrapped", "unwrapped")


@query("""
WITH c AS (SELECT event_id, user_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) OR row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS changed FROM events)
SELECT event_id, (sum(changed) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM c""")
def change_points(spark, sf_dir):
    return op.change_runs(tables.packets(spark, sf_dir), "asset_id", "ordinal", F.col("stream_key")).select(F.col("ordinal").alias("event_id"), "run")


@query("""
SELECT conv_id, turn, start_ms, start_ms + n AS end_ms, lead(start_ms) OVER (PARTITION BY conv_id ORDER BY turn) AS inferred_end FROM (
  SELECT conv_id, turn, length(text) * 40 AS n, coalesce(sum(length(text) * 50) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM conversations)""")
def cue_times(spark, sf_dir):
    """Relative starts summed up, ends from lengths, and ends inferred from the next start."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    start = F.coalesce(F.sum(F.length("text").cast("long") * 50).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    c = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text").cast("long") * 40).alias("n"), start.alias("start_ms"))
    return c.select("conv_id", "turn", "start_ms", (F.col("start_ms") + F.col("n")).alias("end_ms"), F.lead("start_ms").over(w).alias("inferred_end"))


@query(f"""
WITH {_P}, k AS (SELECT user_id, event_id, pts, CASE WHEN event_id % 5 = 0 THEN value END AS v FROM p),
j AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a, first_value(v IGNORE NULLS) OVER f AS z, last_value(CASE WHEN v IS NOT NULL THEN pts END IGNORE NULLS) OVER b AS ta, first_value(CASE WHEN v IS NOT NULL THEN pts END IGNORE NULLS) OVER f AS tz FROM k
  WINDOW b AS (PARTITION BY user_id ORDER BY pts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY pts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, a + (z - a) * (pts - ta) / nullif(tz - ta, 0), a, z), 4) AS v FROM j""")
def keyframe_interpolation(spark, sf_dir):
    p = tables.packets(spark, sf_dir).select("asset_id", "ordinal", "pts", F.when(F.col("ordinal") % 5 == 0, F.col("value")).alias("v"))
    return op.interpolate(p, "asset_id", "pts", "v", "ordinal").select(F.col("ordinal").alias("event_id"), F.round("v", 4).alias("v"))


@query(f"""
WITH {_P}, w AS (SELECT event_type, pts // 500000 AS slot, event_id, row_number() OVER (PARTITION BY event_type, pts // 500000 ORDER BY pts, event_id) AS n FROM p) SELECT event_type, slot, event_id FROM w WHERE n = 1""")
def position_rate_limit(spark, sf_dir):
    """At most one update per half second."""
    p = tables.packets(spark, sf_dir).withColumn("slot", F.expr("pts div 500000"))
    return p.groupBy(F.col("stream_key").alias("event_type"), "slot").agg(F.min_by("ordinal", F.struct("pts", "ordinal")).alias("event_id"))


@query(f"""
WITH {_P}, c AS (SELECT user_id, pts AS t, 1 AS d FROM p UNION ALL SELECT user_id, pts + 600000000, -1 FROM p), g AS (SELECT user_id, t, sum(d) AS d FROM c GROUP BY 1, 2)
SELECT user_id, t, visible FROM (SELECT user_id, t, (sum(d) OVER (PARTITION BY user_id ORDER BY t))::BIGINT AS visible FROM g)""")
def visible_states(spark, sf_dir):
    """Cues shown for ten minutes each: one row per change of the visible state, without an interval join."""
    p = tables.packets(spark, sf_dir).select(F.col("asset_id").alias("user_id"), F.col("pts").alias("t"))
    ends = p.withColumn("d", F.lit(1)).unionByName(p.withColumn("t", F.col("t") + 600_000_000).withColumn("d", F.lit(-1)))
    steps = ends.groupBy("user_id", "t").agg(F.sum("d").alias("d"))
    return steps.select("user_id", "t", F.sum("d").over(Window.partitionBy("user_id").orderBy("t")).alias("visible"))


@query("""
SELECT event_id, round(max(abs(value)) OVER w / nullif(sqrt(avg(value * value) OVER w), 0), 4) AS crest, (count(*) FILTER (WHERE crossed) OVER w)::BIGINT AS crossings FROM (
  SELECT event_id, event_type, value - 50 AS value, (value - 50 >= 0) <> (lag(value - 50) OVER (PARTITION BY event_type ORDER BY event_id) >= 0) AS crossed FROM events)
WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""")
def sliding_meters(spark, sf_dir):
    """Crest factor and zero crossings over the last 16 samples."""
    e = tables.table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("value") - 50).alias("value"))
    e = blocked.with_halo(number(e, "event_type", "event_id", width=blocked.ORDINALS), "n", 16)
    order = Window.partitionBy("event_type", "_block").orderBy("n")
    w = order.rowsBetween(-15, 0)
    e = e.withColumn("crossed", (F.col("value") >= 0) != (F.lag("value").over(order) >= 0))
    crest = F.max(F.abs("value")).over(w) / F.nullif(F.sqrt(F.avg(F.col("value") * F.col("value")).over(w)), F.lit(0.0))
    return e.select("event_id", F.round(crest, 4).alias("crest"), F.count_if("crossed").over(w).alias("crossings"), "_own").where("_own").drop("_own")


@query(f"""
WITH {_P}, s AS (SELECT user_id, pts // 60000000 AS slot, max(value) AS value FROM p GROUP BY 1, 2), g AS (SELECT *, lead(slot) OVER (PARTITION BY user_id ORDER BY slot) AS nxt FROM s)
SELECT user_id, pos AS slot, CASE WHEN pos = slot THEN value END AS value, pos <> slot AS concealed FROM (SELECT *, unnest(range(slot, coalesce(nxt, slot + 1), 1)) AS pos FROM g)""")
def loss_concealment(spark, sf_dir):
    """Missing minutes between a user's first and last, filled in and marked."""
    p = tables.packets(spark, sf_dir)
    slots = p.groupBy(F.col("asset_id").alias("user_id"), F.expr("pts div 60000000").alias("slot")).agg(F.max("value").alias("value"))
    return op.fill_gaps(slots, "user_id", "slot", 1)


@query("SELECT event_type AS section, count(*)::BIGINT AS iterations, round(count(*) / sum(value), 6) AS rate FROM events GROUP BY 1")
def bench_rate(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("section")).agg(F.count(F.lit(1)).alias("iterations"), F.round(F.count(F.lit(1)) / F.sum("value"), 6).alias("rate"))


@query("""
SELECT user_id, origin, seq, event_id FROM (
  SELECT user_id, 0 AS origin, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events WHERE event_type = 'click'
  UNION ALL SELECT user_id, 1, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) FROM events WHERE event_type = 'view')""")
def event_merge(spark, sf_dir):
    """Driver events before terminal ones, each in its own order."""
    e = tables.table(spark, sf_dir, "events").where("event_type IN ('click', 'view')").select("user_id", F.when(F.col("event_type") == "click", 0).otherwise(1).alias("origin"), "event_id")
    return e.withColumn("seq", F.row_number().over(Window.partitionBy("user_id", "origin").orderBy("event_id")).cast("long"))


@query("""
WITH m AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'opened' WHEN 'error' THEN 'finished' ELSE 'frame' END AS kind FROM events),
s AS (SELECT user_id, min(ts) FILTER (kind = 'opened') AS opened, min(ts) FILTER (kind = 'started') AS started, arg_min(kind, (ts, event_id)) FILTER (kind <> 'opened') AS first FROM m GROUP BY 1)
SELECT user_id, CASE WHEN started IS NULL THEN 'never started' WHEN first = 'finished' THEN 'finished early' WHEN first <> 'started' THEN 'out of order' WHEN epoch_us(started) - epoch_us(opened) > 30000000 THEN 'late' END AS fault FROM s""")
def session_starts(spark, sf_dir):
    """Every user's messages as a session: is its first one the start, and in time?"""
    e = tables.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "view", "opened").when(F.col("event_type") == "error", "finished").otherwise("frame")
    return stateful.start_faults(e.withColumn("kind", kind), "user_id", "ts", "event_id", "kind")
