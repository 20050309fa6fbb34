"""Containers, addresses, subtitles and generators."""

import base64
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import audio
from framelake.sources import datasource, formats, generate, subtitles, uri


def test_wav_round_trip(spark):
    body = np.array([(i * 73) & 0x7FFF for i in range(5000)], "<i2").tobytes()
    wav = datasource.wav_header(1, 8000, 16, len(body)) + body
    packets = datasource.demux(spark.createDataFrame([("u", bytearray(wav)), ("v", bytearray(wav[:44]))], "uri string, data binary"), "wav")
    rows = packets.orderBy("pts").collect()
    assert [r.duration for r in rows] == [1024] * 4 + [904] and {r.tb_den for r in rows} == {8000}
    again = datasource.mux_wav(packets.repartition(3), 1, 8000).first()
    assert bytes(again.data) == wav


def test_wav_extensible_is_for_many_channels_or_bits():
    mask = datasource.channel_mask(["FrontLeft", "FrontRight", "FrontCenter", "LowFrequency", "SideLeft", "SideRight"])
    assert mask == 0x60F
    info, _ = datasource.parse_wav(datasource.wav_header(6, 48000, 16, 0, mask=mask))
    assert (info["tag"], info["channels"], info["mask"]) == (0xFFFE, 6, 0x60F)
    assert datasource.parse_wav(datasource.wav_header(2, 48000, 16, 0))[0]["tag"] == 1
    assert datasource.parse_wav(datasource.wav_header(2, 48000, 16, 0, extensible=True))[0]["tag"] == 0xFFFE
    with pytest.raises(ValueError):
        datasource.parse_wav(b"nothing")


def test_ivf():
    head = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, b"VP80", 64, 48, 30, 1, 2, 0)
    data = head + struct.pack("<IQ", 3, 0) + b"abc" + struct.pack("<IQ", 1, 5) + b"d"
    assert [(r[1], r[2], r[3], r[6], r[7]) for r in datasource.ivf_packets(data)] == [(1, 30, 0, True, b"abc"), (1, 30, 5, False, b"d")]


def ts_unit(pid, pts, key, payload):
    stamp = bytes([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 255, (pts >> 15 & 127) << 1 | 1, pts >> 7 & 255, (pts & 127) << 1 | 1])
    rest = b"\0\0\1\xe0\0\0\x80\x80\x05" + stamp + payload
    out, start = b"", 0x40
    while rest:
        room = 184 - (8 if start and key else 0)
        part = rest[:room]
        pad = 184 - len(part)
        field = bytes([pad - 1, 0x40 if start and key else 0]) + b"\xff" * (pad - 2) if pad >= 2 else b"\0" * pad
        out += bytes([0x47, start | pid >> 8, pid & 255, 0x30 if pad else 0x10]) + field + part
        rest, start = rest[len(part) :], 0
    return out


def test_transport_stream():
    units = [(256 + s, 3000 * i + (1 << 32), s == 0 and i % 4 == 0, bytes((31 * k + 17 * i + 7 * s) % 251 for k in range(40 if s else 1000))) for i in range(8) for s in (0, 1)]
    data = b"".join(ts_unit(*u) for u in units)
    got = list(datasource.ts_packets(data))
    assert [(r[0], r[3], r[6], r[7]) for r in got] == [(pid - 256, pts, key, body) for pid, pts, key, body in units]
    with pytest.raises(ValueError):
        list(datasource.ts_packets(b"\0" * 188))


def test_transport_streams_written(spark):
    from framelake.sources import transport

    sizes = (0, 1, 155, 167, 168, 169, 170, 171, 349, 353, 354, 355, 1000, 20_000)
    units = [("a", 2 * i + s, s, 3000 * i + (1 << 33) - 9000, s == 0 and i % 3 == 0, bytes((31 * k + i) % 251 for k in range(n))) for i, n in enumerate(sizes) for s in (0, 1)]
    units += [("b", 0, 5, None, True, None)]
    packets = spark.createDataFrame(units, "uri string, at long, stream_index int, pts long, keyframe boolean, data binary")
    files = {r.uri: bytes(r.data) for r in transport.mux_ts(packets.repartition(3)).collect()}
    got = list(datasource.ts_packets(files["a"]))
    assert [(r[0], r[3], r[6], r[7]) for r in got] == [(s, pts % (1 << 33), key, body) for _, _, s, pts, key, body in units[:-1]]
    assert [(r[3], r[6], r[7]) for r in datasource.ts_packets(files["b"])] == [(None, True, b"")]
    cells = [files["a"][i : i + 188] for i in range(0, len(files["a"]), 188)]
    assert all(c[0] == 0x47 and len(c) == 188 for c in cells)
    for pid in (256, 257):
        mine = [c[3] & 15 for c in cells if (c[1] & 31) << 8 | c[2] == pid]
        assert mine == [i % 16 for i in range(len(mine))]

    def crc(data, value=0xFFFFFFFF):  # bit by bit; a section with its own checksum behind gives 0
        for bit in (b >> i & 1 for b in data for i in range(7, -1, -1)):
            value = (value << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if (value >> 31) ^ bit else 0)
        return value

    for cell, pid, table in ((cells[0], 0, 0), (cells[1], transport.MAP_PID, 2)):
        length = int.from_bytes(cell[6:8], "big") & 0xFFF
        assert (cell[1] & 31) << 8 | cell[2] == pid and cell[5] == table and crc(cell[5 : 8 + length]) == 0


def test_companding():
    assert datasource.decode_ulaw(bytes([0xFF, 0x7F, 0x00, 0x80])).tolist() == [0, 0, -32124, 32124]
    assert datasource.decode_alaw(bytes([0xD5, 0x55, 0xAA, 0x2A])).tolist() == [8, -8, 32256, -32256]


def test_probe(spark):
    assert formats.probe_bytes(b"RIFF\0\0\0\0WAVEfmt ") == "wav" and formats.probe_bytes(b"Good day") == "text"
    assert formats.probe_bytes((b"G" + b"\0" * 187) * 3) == "mpegts"
    rows = spark.createDataFrame([(bytearray(b"MAC abc"), None), (bytearray(b"P6 1 1"), "ppm"), (bytearray(b""), "wav"), (None, None)], "d binary, e string")
    assert [r.p.format for r in rows.select(formats.probe(F.col("d"), F.col("e")).alias("p")).collect()] == ["ape", "pnm", "text", "text"]
    assert formats.format_for_path("a/b.WAV?x") == "wav"
    for bad in ("a/b", "a/b.zzz"):
        with pytest.raises(formats.FormatNotFound):
            formats.format_for_path(bad)


def test_addresses(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"hello world")
    data = lambda u: bytes(uri.open_uri(spark, u).first().data)
    assert data(f"file://{tmp_path}/f.bin") == b"hello world"
    assert data("data:text/plain,a%20b") == b"a b" and data("data:;base64,aGk=") == b"hi"
    assert data("slice:6+5!" + uri.put_memory("m", b"hello world")) == b"world"
    assert data("concat:mem://m|data:,!|mem://m") == b"hello world!hello world"
    for bad, shape in (("gopher://x", None), ("mem://none", None), ("mem://m", "frames"), ("slice:x", None)):
        with pytest.raises(uri.Unsupported):
            uri.open_uri(spark, bad, shape)
    assert uri.title_paths(["a", "b"], "o-%s.mkv") == {"a": "o-a.mkv", "b": "o-b.mkv"}
    for labels, template in (([], "x"), (["a", "b"], "x")):
        with pytest.raises(ValueError):
            uri.title_paths(labels, template)
    assert uri.read_job_source("{}", "-", lambda: "[]") == "{}" and uri.read_job_source(None, "-", lambda: "[]") == "[]"


@pytest.mark.parametrize("kind", ["sine", "chirp", "fm", "dtmf", "multitone", "ringmod", "tremolo", "pwm", "supersaw", "dc", "impulse", "noise"])
def test_audio_generators_stay_in_range(spark, kind):
    lo, hi, n = uri.open_uri(spark, f"generate://audio/{kind}?samples=2000&rate=8000").agg(F.min("value"), F.max("value"), F.count("value")).first()
    assert n == 2000 and -1.0001 <= lo <= hi <= 1.0001


def test_generators_do_not_depend_on_partitions(spark):
    rows = generate.image(spark, "noise", 16, 8, frames=2)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, rows.repartition(5).collect())) and rows.count() == 256
    for kind in ("xc", "gradient", "ramp", "pattern", "plasma", "zoneplate"):
        lo, hi = generate.image(spark, kind, 16, 8).agg(F.min("value"), F.max("value")).first()
        assert 0 <= lo <= hi <= 1.0001
    assert generate.shorthand("xc:0.2") == "generate://image/xc?level=0.2" and generate.shorthand("a.png") == "a.png"
    assert len(audio.tone(100, 8000)) == 100


SRT = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\n2\r\n01:00:00,000 --> 01:00:01,000\r\nBye\r\n"


def test_subtitles(spark):
    files = spark.createDataFrame([("a", SRT), ("b", "WEBVTT\n\nNOTE x\n\n00:01.000 --> 00:02.000 align:left\nHi\n")], "uri string, text string")
    cues = subtitles.parse_arrow_cues(files)
    got = [tuple(r) for r in cues.orderBy("uri", "cue_no").collect()]
    assert got == [("a", 1, 1_000_000, 2_500_000, "Hello\nthere"), ("a", 2, 3_600_000_000, 3_601_000_000, "Bye"), ("b", 1, 1_000_000, 2_000_000, "Hi")]
    for kind in ("subrip", "webvtt"):
        back = subtitles.parse_arrow_cues(subtitles.write_cues(cues, kind))
        assert [tuple(r) for r in back.orderBy("uri", "cue_no").collect()] == got


def test_line_subtitles(spark):
    def cues(parse, text):
        return [tuple(r)[1:] for r in parse(spark.createDataFrame([("u", text)], "uri string, text string")).orderBy("cue_no").collect()]

    assert cues(subtitles.parse_microdvd, "{25}{50}a|b\nnoise\n{75}{100}c") == [(1, 1_000_000, 2_000_000, "a\nb"), (2, 3_000_000, 4_000_000, "c")]
    assert cues(subtitles.parse_mpl2, "[10][25]x") == [(1, 1_000_000, 2_500_000, "x")]
    assert cues(subtitles.parse_vplayer, "00:00:01:a\n00:00:03:b") == [(1, 1_000_000, 3_000_000, "a"), (2, 3_000_000, 7_000_000, "b")]
    assert cues(subtitles.parse_mpsub, "1 2\na\n\n0.5 1\nb") == [(1, 1_000_000, 3_000_000, "a"), (2, 3_500_000, 4_500_000, "b")]


def id3(frames, version=3):
    size = (lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])) if version == 4 else (lambda n: struct.pack(">I", n))
    body = b"".join(name + size(len(data)) + b"\0\0" + data for name, data in frames)
    n = len(body)
    return b"ID3" + bytes([version, 0, 0, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def test_tags(spark):
    from framelake.sources import tags

    two = id3([(b"TIT2", b"\x03T\xc3\xa9st"), (b"TPE1", b"\x01" + "Ärt".encode("utf-16")), (b"APIC", b"\0" * 200), (b"COMM", b"\0eng\0hello")], 4)
    assert tags.id3v2(two) == [("title", "Tést"), ("artist", "Ärt"), ("comment", "hello")]
    assert tags.id3v2(id3([(b"TALB", b"\0Album")])) == [("album", "Album")] and tags.id3v2(two[:30]) == [("title", "Tést")] and tags.id3v2(b"") == []
    one = b"TAG" + b"Song".ljust(30, b"\0") + b"Me".ljust(30, b"\0") + b"\0" * 30 + b"1999" + b"note".ljust(28, b"\0") + b"\0\x07\x01"
    assert tags.id3v1(b"x" * 50 + one) == [("title", "Song"), ("artist", "Me"), ("date", "1999"), ("comment", "note"), ("track", "7")]
    block = struct.pack("<I", 1) + b"v" + struct.pack("<I", 2) + struct.pack("<I", 7) + b"TITLE=a" + struct.pack("<I", 3) + b"K=b"
    assert tags.vorbis_comments(block) == [("title", "a"), ("k", "b")]
    rows = tags.tags(spark.createDataFrame([("a", bytearray(two)), ("b", bytearray(one)), ("c", None)], "uri string, data binary")).collect()
    assert [(r.uri, r.ord, r.k) for r in rows][:4] == [("a", 0, "title"), ("a", 1, "artist"), ("a", 2, "comment"), ("b", 0, "title")]


def test_addresses_of_a_column(spark):
    """Rows give what open_uri() gives one by one, and null where that is an error."""

    b64 = base64.b64encode(bytes(range(60))).decode()
    good = [f"data:;base64,{b64}", "data:text/plain,a+b%20c%2Bd", "data:,", f"slice:3+10!data:x;base64,{b64}", f"slice:2+3!slice:10+20!data:;base64,{b64}", f"slice:50+99!data:;base64,{b64}", f"concat:data:,x|slice:1+2!data:;base64,{b64}|data:,y", "data:,line%0Abreak"]
    bad = ["mem://x", "slice:1!data:,abc", "concat:data:,x|http://y", "", None]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad)], "i int, uri string")
    got = {r.i: None if r.data is None else bytes(r.data) for r in uri.resolved(rows).collect()}
    for i, u in enumerate(good):
        assert got[i] == bytes(uri.open_uri(spark, u).first().data), u
    assert [got[len(good) + i] for i in range(len(bad))] == [None] * len(bad)


def test_formats_of_a_column(spark):

    paths = ["a.wav", "x/y.b/c.PPM?d.wav", "none", "dir.wav/none", "a.xyz", None, "", ".srt"]
    got = [r.f for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").select("i", formats.format_of(F.col("p")).alias("f")).orderBy("i").collect()]

    def one(path):
        try:
            return formats.format_for_path(path) if path is not None else None
        except formats.FormatNotFound:
            return None

    assert got == [one(p) for p in paths] and got[:2] == ["wav", "pnm"]


def test_ass_files(spark):
    """Columns in the order that a file names, commas and codes in texts, other lines ignored."""
    text = """\ufeff[Script Info]\r
Title: Dialogue: none\r
[V4+ Styles]
Format: Name, Fontname
Style: Default,Sans
[Events]
Format: Start, End, Layer, Text
Comment: 0:00:00.00,0:00:01.00,0,not shown
Dialogue: 0:00:01.50,1:02:03.04,0,one, {\\i1}two{\\i0}\\Nthree{\\pos(1,2)} {\\b1}four{\\b}
Dialogue: x,0:00:03.00,0,bad time
Dialogue: 0:00:05.00,0:00:06.00,0,
"""
    bare = "[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,a, b"
    got = [tuple(r) for r in subtitles.parse_ass(spark.createDataFrame([("u", text), ("v", bare), ("w", ""), ("x", None)], "uri string, text string")).orderBy("uri", "cue_no").collect()]
    assert got == [("u", 1, 1_500_000, 3_723_040_000, "one, <i>two</i>\nthree <b>four</b>"), ("u", 2, 5_000_000, 6_000_000, ""), ("v", 1, 1_000_000, 2_000_000, "a, b")]


@pytest.mark.parametrize("kind", ["subrip", "webvtt", "ass", "pjs", "microdvd", "mpl2", "aqtitle", "subviewer", "ttml"])
def test_every_writer_is_read_back(spark, kind):
    rows = [("u", 1, 0, 1_000_000, "first"), ("u", 2, 3_600_000_000, 3_601_000_000, "two\nlines, with <commas> & marks" if kind == "ttml" else "two\nlines, with commas"), ("v", 1, 5_000_000, 7_000_000, "<i>x</i>" if kind in ("subrip", "webvtt", "ass") else "x")]
    cues = spark.createDataFrame(rows, "uri string, cue_no long, start_us long, end_us long, text string")
    back = subtitles.PARSERS[kind](subtitles.write_cues(cues, kind))
    assert sorted(map(tuple, back.collect())) == rows
    with pytest.raises(ValueError):
        subtitles.write_cues(cues, "sami")


def test_timed_text_times_and_marks(spark):
    text = """<tt><body><p begin="1.5s" end='2500ms' xml:id="a"><span tts:color="red">a</span><br/>b &amp;lt; c</p><p begin="00:00:03.25" end="00:00:04">d</p><p begin="x" end="1s">e</p><p>never closed"""
    got = [tuple(r)[1:] for r in subtitles.parse_ttml(spark.createDataFrame([("u", text)], "uri string, text string")).orderBy("cue_no").collect()]
    assert got == [(1, 1_500_000, 2_500_000, "a\nb &lt; c"), (2, 3_250_000, 4_000_000, "d")]
    aq = "-->> 25\nline one\nline two\n\n-->> 50\n\n-->> 100\nlast"
    assert [tuple(r)[1:] for r in subtitles.parse_aqtitle(spark.createDataFrame([("u", aq)], "uri string, text string")).orderBy("cue_no").collect()] == [(1, 1_000_000, 2_000_000, "line one\nline two"), (2, 4_000_000, 8_000_000, "last")]


def test_ass_columns_are_found_once_a_file(spark):
    """A file's Format line is matched once for all its lines, and their times where they stand."""
    from framelake.sources import subtitles

    text = "[Events]\nFormat: Layer, End, Start, Text\nDialogue: 0,0:00:02.50,0:00:01.00,a, b\nDialogue: 0,bad,0:00:01.00,c\nDialogue: 0,0:00:09.00,0:00:08.01,d"
    rows = subtitles.parse_ass(spark.createDataFrame([("x", text), ("y", None), ("z", "Dialogue: 0,0:00:00.10,0:00:00.20,,,,,,,e")], "uri string, text string"))
    assert sorted(map(tuple, rows.collect())) == [("x", 1, 1_000_000, 2_500_000, "a, b"), ("x", 2, 8_010_000, 9_000_000, "d"), ("z", 1, 100_000, 200_000, "e")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("[Events") <= 3
