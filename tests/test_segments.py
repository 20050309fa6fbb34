"""The segmented source against the whole-file demuxer, its writer's commits, its stream, and its index."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from framelake.sources import datasource, segments, transport

RNG = random.Random(3)


@pytest.fixture(scope="module")
def rows():
    """Three streams of packets from empty to a hundred cells, without timestamps at times, and a title of one stream."""
    out = []
    for n in range(120):
        size = RNG.choice([0, 1, 40, 170, 171, 184, 600, 4096, 20_000 if n % 40 == 5 else 10])
        out.append(("a b/ü", n, n % 3, None if n % 11 == 4 else n * 3003, n % 6 == 0, RNG.randbytes(size)))
    return out + [("one", n, 5, n * 100, True, bytes([n])) for n in range(20)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "uri string, at long, stream_index int, pts long, keyframe boolean, data binary").repartition(3)


def shown(df):
    return sorted((r.uri, r.stream_index, -1 if r.pts is None else r.pts, r.keyframe, bytes(r.data)) for r in df.collect())


@pytest.mark.parametrize("size, files", [(188 * 5, 4), (188 * 17, 3), (188 * 50 + 5, 1), (1 << 30, 9)])
def test_ranges_equal_whole_files(spark, rows, tmp_path, size, files):
    packets = frame(spark, rows)
    want = shown(datasource.demux(transport.mux_ts(packets), "mpegts"))
    segments.write_titles(packets, str(tmp_path / "t"), files)
    units = segments.read_titles(spark, str(tmp_path / "t"), size).cache()
    assert shown(segments.as_packets(units)) == want and len(want) == len(rows)
    tasks = spark.read.format(segments.FORMAT).option("rangeBytes", size).load(str(tmp_path / "t")).rdd.getNumPartitions()
    total = sum(f.stat().st_size for f in (tmp_path / "t").rglob("*.ts"))
    assert tasks >= max(1, total // max(188, size // 188 * 188)) and not list((tmp_path / "t").glob("_pending*"))
    # the segments of a title, one after another, are the stream that one task would write
    whole = {r.uri: bytes(r.data) for r in transport.mux_ts(packets).collect()}
    for title, data in whole.items():
        names = sorted(f for t, f, _ in segments.listed(str(tmp_path / "t")) if t == title)
        assert b"".join(Path(n).read_bytes() for n in names) == data
    units.unpersist()


def test_extents_hold_exactly_their_packets(spark, rows, tmp_path):
    segments.write_titles(frame(spark, rows), str(tmp_path / "t"), 4)
    units = segments.read_titles(spark, str(tmp_path / "t"), 188 * 9).cache()
    again = segments.joined(segments.read_extents(units.select("title", "pid", F.explode("extents").alias("e")).select("title", "pid", "e.*")))
    take = lambda df: sorted((r.title, r.file, r.offset, r.pid, bytes(r.data)) for r in df.collect())
    assert take(again) == take(units)
    assert units.where(F.size("extents") > 1).count() > 3
    units.unpersist()


@pytest.mark.parametrize("every", [1, 3])
def test_seeks_read_what_the_index_names(spark, tmp_path, every):
    rows = [("t", n, n % 2, 2**33 - 5000 + n * 100, n % 5 == 0, bytes([n % 251]) * (n * 13 % 900)) for n in range(200)]
    segments.write_titles(frame(spark, [(a, b, c, d % 2**33, e, f) for a, b, c, d, e, f in rows]), str(tmp_path / "t"), 3)
    index = segments.seek_index(segments.read_titles(spark, str(tmp_path / "t"), 188 * 20), every).cache()
    targets = [(stream, 2**33 - 5000 + t) for stream in (0, 1) for t in range(-150, 20_100, 333)]
    asked = spark.createDataFrame([("t", 0x100 + s, t) for s, t in targets], "title string, pid int, target long")
    got = {(r.pid - 0x100, r.target): (r.ticks, None if r.data is None else bytes(r.data)) for r in segments.seek(index, asked).collect()}
    for s, t in targets:
        keys = [r for r in rows if r[2] == s and r[4]][::every]
        keys = [r for r in keys if r[3] <= t]
        assert got[s, t] == ((keys[-1][3], keys[-1][5]) if keys else (None, None))
    found = segments.indexed(index, asked.limit(1)).where("extents IS NOT NULL")
    assert found.select(F.explode("extents")).count() <= 2 * found.count()
    index.unpersist()


def test_commits(spark, rows, tmp_path):
    """Appended segments come after those that are there; a failed job leaves nothing; overwriting replaces."""
    path = str(tmp_path / "t")
    packets = frame(spark, rows)
    segments.write_titles(packets.where("at < 60"), path, 2)
    names = {f for _, f, _ in segments.listed(path)}
    broken = packets.where("at >= 60").withColumn("data", F.when(F.col("at") == 100, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="broken"):
        segments.write_titles(broken, path, 2)
    assert {f for _, f, _ in segments.listed(path)} == names and not list((tmp_path / "t").glob("_pending*"))
    segments.write_titles(packets.where("at >= 60"), path, 2)
    assert {f for _, f, _ in segments.listed(path)} > names
    assert shown(segments.as_packets(segments.read_titles(spark, path, 188 * 11))) == shown(datasource.demux(transport.mux_ts(packets), "mpegts"))
    segments.write_titles(packets.where("uri = 'one'"), path, 1, "overwrite")
    assert {t for t, _, _ in segments.listed(path)} == {"one"}
    assert segments.read_titles(spark, str(tmp_path / "none"), 188).count() == 0


def test_lost_sync(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "00000000.ts").write_bytes(b"\x47" + bytes(187) + b"\x46" + bytes(187))
    with pytest.raises(Exception, match="lost sync at 188"):
        segments.read_titles(spark, str(tmp_path), 1 << 20).count()


def test_stream_of_segments(spark, rows, tmp_path):
    """A stream takes every segment once, also those that come between its batches, and goes on from its checkpoint."""
    path, pieces = str(tmp_path / "t"), []
    packets = frame(spark, rows)
    segments.write_titles(packets.where("at < 50"), path, 2)

    def start():
        stream = spark.readStream.format(segments.FORMAT).option("rangeBytes", 188 * 30).load(path)
        return stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda batch, _: pieces.extend(batch.collect())).start()

    for part in ("at >= 50 AND at < 90", "at >= 90"):
        query = start()
        query.processAllAvailable()
        segments.write_titles(packets.where(part), path, 2)
        query.processAllAvailable()
        query.stop()
    units = segments.joined(spark.createDataFrame(pieces, segments.PIECES))
    assert shown(segments.as_packets(units)) == shown(datasource.demux(transport.mux_ts(packets), "mpegts"))


@pytest.mark.parametrize("name", ["segmented_round_trip", "indexed_seek"])
def test_ranges_grow_with_the_archive(spark, monkeypatch, name):
    """A larger archive has longer ranges, not more of them, and is cut once."""
    from framelake.queries import archives

    read, found = archives.segments.read_pieces, []

    def noted(*args):
        found.append(read(*args).rdd.getNumPartitions())
        return read(*args)

    monkeypatch.setattr(archives.segments, "read_pieces", noted)
    want = sorted(map(tuple, archives.QUERIES[name](spark, "/root/testdata/sf0.001").collect()), key=str)
    monkeypatch.setattr(archives, "RANGE", 188 * 4)
    monkeypatch.setattr(archives, "MOST_RANGES", 30)
    monkeypatch.setattr(archives, "SEGMENT_ROWS", 100)
    got = sorted(map(tuple, archives.QUERIES[name](spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == want and len(got) > 10
    assert len(found) == 2 and found[1] <= 30 + 10 + 3  # the last range of each of ten segments, and of those that two titles share, is shorter
