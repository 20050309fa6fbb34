"""Transport streams on disk: written in segments, read in byte ranges, sought by an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..session import scratch_folder
from ..sources import segments
from .registrar import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

#: Bytes of a range, so few that packets are cut by it, and segments of all titles, on small tables.
RANGE, SEGMENTS = 188 * 1000, 6
#: Ranges that an archive is cut into at most, up to segments.RANGE_BYTES each; packets of a segment on large tables, about.
MOST_RANGES, SEGMENT_ROWS = 512, 500_000


def _written(spark, sf_dir) -> str:
    """Every fourth user's packets are a title of five streams; a pts is 3003 ticks a packet, from shortly before the counter wraps."""
    e = tables.table(spark, sf_dir, "events")
    stream = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("event_type")).cast("int")
    payload = F.concat("props", F.repeat(F.lit("x"), (F.col("event_id") % 400).cast("int"))).cast("binary")
    packets = e.select(F.concat(F.lit("user/"), F.col("user_id") % 4).alias("uri"), F.col("event_id").alias("at"), stream.alias("stream_index"), ((1 << 33) - 3_000_000 + F.col("event_id") * 3003).alias("pts"), (F.col("event_id") % 4 == 0).alias("keyframe"), payload.alias("data"))
    path = scratch_folder(spark, "titles")
    segments.write_titles(packets, path, max(SEGMENTS, e.count() // SEGMENT_ROWS))
    return path


def _pieces(spark, sf_dir, with_data: bool):
    """The archive's pieces as a table: ranges grow with the archive, and are cut once however often their packets are read."""
    path, table = _written(spark, sf_dir), scratch_folder(spark, "pieces")
    total = sum(size for _, _, size in segments.listed(path))
    pieces = segments.read_pieces(spark, path, min(max(RANGE, total // MOST_RANGES), segments.RANGE_BYTES))
    pieces = pieces if with_data else pieces.withColumn("data", F.lit(None).cast("binary"))
    pieces.write.parquet(table)
    return spark.read.parquet(table)


@query("""
WITH f AS (SELECT *, user_id % 4 AS title, min(event_id) OVER (PARTITION BY user_id % 4, event_type) AS seen FROM events)
SELECT 'user/' || title AS uri, (dense_rank() OVER (PARTITION BY title ORDER BY seen) - 1)::INT AS stream_index, (8589934592 - 3000000 + event_id * 3003) % 8589934592 AS pts, event_id % 4 = 0 AS keyframe, md5(props || repeat('x', event_id % 400)) AS md5 FROM f""")
def segmented_round_trip(spark, sf_dir):
    """Packets written by several tasks a title, and read by more tasks than there are files."""
    packets = segments.as_packets(segments.joined(_pieces(spark, sf_dir, True)))
    return packets.select("uri", "stream_index", "pts", "keyframe", F.md5("data").alias("md5"))


@query("""
WITH t AS (SELECT user_id % 4 AS title, event_type, event_id FROM events WHERE event_id % 50 = 7),
k AS (SELECT user_id % 4 AS title, event_type, event_id, md5(props || repeat('x', event_id % 400)) AS md5 FROM events WHERE event_id % 4 = 0)
SELECT 'user/' || t.title AS title, t.event_id, k.event_id AS key_id, k.md5 FROM t ASOF LEFT JOIN k ON t.title = k.title AND t.event_type = k.event_type AND t.event_id >= k.event_id""")
def indexed_seek(spark, sf_dir):
    """Every fiftieth packet's time is sought in its stream by an index of all keyframes: of the titles only the packets that the index names are read again."""
    # the archive is read once: what is known of its packets is a table, from which the index follows
    table = scratch_folder(spark, "packets")
    segments.joined(_pieces(spark, sf_dir, False)).drop("data").write.parquet(table)
    units, folder = spark.read.parquet(table), scratch_folder(spark, "index")
    segments.seek_index(units).write.parquet(folder)
    e = tables.table(spark, sf_dir, "events").where("event_id % 50 = 7")
    pid = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("event_type")).cast("int") + 0x100
    zero = (1 << 33) - 3_000_000
    targets = e.select(F.concat(F.lit("user/"), F.col("user_id") % 4).alias("title"), pid.alias("pid"), (F.col("event_id") * 3003 + zero).alias("target"))
    # a stream's times start in the count of the counter in which its first packet lies
    turns = F.when(F.col("first") < zero, F.lit(1 << 33)).otherwise(0)
    index = spark.read.parquet(folder)
    starts = units.groupBy("title", "pid").agg(F.min_by("pts", F.struct("file", "offset")).alias("first")).select("title", "pid", turns.alias("turn"))
    found = segments.seek(index, targets.join(starts, ["title", "pid"]).withColumn("target", F.col("target") - F.col("turn")).drop("turn"))
    shown = found.join(starts, ["title", "pid"])
    number = lambda c: ((F.col(c) + F.col("turn") - zero) / 3003).cast("long")
    return shown.select("title", number("target").alias("event_id"), number("ticks").alias("key_id"), F.md5("data").alias("md5"))
