"""Job graphs: parsing, errors by name, description, rewriting, compilation."""

import json
import re

import pytest
from pyspark.sql import functions as F

from framelake.plans.job import Dag, Job, JobError, compile_job, conversion_path, insert_conversions


def job(**outputs):
    return Job.from_json(json.dumps({k.replace("AT", "@"): v for k, v in outputs.items()}))


def test_description():
    text = job(ATin={"all": [{"from": "x.wav"}]}, out={"audio": [{"codec": "flac", "filter": "volume", "params": {"gain_db": -3}, "input": {"from": "@in"}}]}).to_dag().describe()
    assert text.split("\n") == ["output: out", "  mux(out)", "    encode(flac)", "      filter(volume) {'gain_db': -3}", "        alias(@in)", "          demuxer(x.wav)"]


@pytest.mark.parametrize(
    ("outputs", "said"),
    [
        ({"o": {"video": [{"convert": "yuv999", "input": {"from": "x"}}]}}, "o: unknown pixel format yuv999"),
        ({"o": {"audio": [{"filter": "nope", "input": {"from": "x"}}]}}, "o: unknown filter nope"),
        ({"@a": {"all": [{"from": "@b"}]}, "@b": {"all": [{"from": "@a"}]}, "o": {"all": [{"from": "@a"}]}}, "alias cycle"),
        ({"o": {"all": [{"from": "@none"}]}}, "unknown alias @none"),
        ({"o": {"smell": []}}, "unknown track group smell"),
        ({"o": {"all": [{}]}}, "needs from, filter or convert"),
        ({"@a": {"all": [{"from": "x"}]}}, "no output"),
        ({"o": {"all": [{"from": 5}]}}, "o: from is no text: 5"),
        ({"o": {"all": {"from": "x"}}}, "o: all is no list of tracks"),
        ({"o": {"all": "x"}}, "o: all is no list of tracks"),
        ({"o": {"all": []}}, "o: has no track"),
        ({"o": {"all": ["x"]}}, "o: a track is not an object"),
        ({"o": ["x"]}, "o: not an object"),
        ({"o": {"all": [{"filter": ["volume"], "input": {"from": "x"}}]}}, "o: filter is no text"),
        ({"o": {"all": [{"filter": "volume", "params": [1], "input": {"from": "x"}}]}}, "o: params is not an object"),
        ({"o": {"all": [{"filter": "volume", "params": {"scale": {"a": 1}}, "input": {"from": "x"}}]}}, "o: params holds an object"),
        ({"o": {"all": [{"codec": 3, "from": "x"}]}}, "o: codec is no text"),
        ({"o": {"all": [{"codec": "bmp", "codec_params": "x", "from": "x"}]}}, "o: codec_params is not an object"),
        ({"o": {"all": [{"filter": "volume", "input": 7}]}}, "o: a track is not an object"),
        ({"o": {"all": [{"convert": ["rgb24"], "input": {"from": "x"}}]}}, "o: unknown pixel format"),
        ({"o": {"all": [{"filter": "volume", "port": "low", "input": {"from": "x"}}]}}, "o: volume has no port low"),
        ({"o": {"all": [{"filter": "crossover", "port": ["low"], "input": {"from": "x"}}]}}, "o: crossover has no port"),
    ],
)
def test_errors_name_the_output(outputs, said):
    with pytest.raises(JobError, match=re.escape(said)):
        Job.from_json(json.dumps(outputs)).validate()


def test_text_errors():
    for bad in ("", "[]", "{", '{"threads": "x", "o": {"all": [{"from": "x"}]}}'):
        with pytest.raises(JobError):
            Job.from_json(bad)
    assert Job.from_json('{"threads": 4, "o": {"all": [{"from": "x"}]}}').validate() == "OK: 1 output(s)"


def test_conversions_are_inserted_below_encoders_that_need_them():
    dag = job(o={"video": [{"codec": "fake", "from": "x"}]}).to_dag()
    changed = insert_conversions(dag, {"fake": ("yuv420p",)}, lambda n: "rgb24")
    assert "convert(yuv420p)" in changed.describe()
    assert insert_conversions(dag, {"fake": ("rgb24",)}, lambda n: "rgb24") == dag and isinstance(changed, Dag)


def test_conversion_path():
    edges = {"a": {"b", "c"}, "b": {"d"}, "c": {"d"}, "d": {"e"}}
    assert conversion_path(edges, "a", "e") == ["a", "b", "d", "e"] and conversion_path(edges, "e", "a") is None and conversion_path(edges, "a", "a") == ["a"]


def test_compile(spark):
    frames = spark.createDataFrame([("Audio", 1, 2.0, True, "pcm"), ("Video", 2, 4.0, False, "vp8")], "media_type string, n int, value double, keyframe boolean, codec_id string")
    opened = []

    def read(_, address):
        opened.append(address)
        return frames

    outputs = {"@in": {"all": [{"from": "x"}]}, "@null": {"all": [{"from": "@in"}]}, "o": {"audio": [{"filter": "volume", "params": {"scale": 2}, "input": {"from": "x"}}], "video": [{"codec": "vp8", "from": "x"}]}}
    built = compile_job(spark, Job.from_json(json.dumps(outputs)), read)
    assert built["@null"].count() == 2
    rows = built["o"].orderBy("track_no").select("track_no", "n", "value", F.col("codec_id")).collect()
    assert [tuple(r) for r in rows] == [(0, 1, 4.0, "pcm"), (1, 2, 4.0, "vp8")]


def test_no_node_only_labels_rows(spark):
    """An encoder that is not there, and pixels that are not there, stop a job; packets in the codec are copied."""
    packets = spark.createDataFrame([("vp8", b"a"), ("vp9", b"b")], "codec_id string, data binary")
    made = lambda tree: compile_job(spark, Job.from_json(json.dumps({"@out": {"all": [tree]}})), lambda *_: packets)["@out"]
    with pytest.raises(Exception, match="nothing can encode vp8 from vp9"):
        made({"codec": "vp8", "from": "x"}).collect()
    packets = packets.where("codec_id = 'vp8'")
    assert [r.codec_id for r in made({"codec": "vp8", "from": "x"}).collect()] == ["vp8"]
    with pytest.raises(JobError, match="needs pixels, not packets"):
        made({"convert": "rgb24", "input": {"from": "x"}})
    packets = spark.range(3)
    with pytest.raises(JobError, match=r"nothing can encode h264 from \(id\)"):
        made({"codec": "h264", "from": "x"})


def test_lists_in_parameters(spark):
    """Equal nodes are compiled once, whatever their parameters hold."""
    from framelake.plans import job as plans

    seen = []
    plans.FILTERS["probe"] = lambda frames, params: seen.append(params) or frames
    try:
        tree = {"filter": "probe", "params": {"bands": [[1, 2], ["a"]]}, "input": {"from": "x"}}
        compile_job(spark, Job.from_json(json.dumps({"@out": {"all": [tree, tree]}})), lambda *_: spark.range(2))
    finally:
        del plans.FILTERS["probe"]
    assert seen == [{"bands": ((1, 2), ("a",))}]


def test_parameters_that_are_no_numbers(spark):
    samples = spark.range(4).selectExpr("'s' AS stream_key", "id AS ordinal", "1.0D AS value")
    for name, params in (("volume", {"scale": "x"}), ("echo", {"delay": [1]}), ("resize", {"w": None}), ("resize", {"kind": "bicubic"}), ("resize", {"w": 4, "h": 4, "new_w": 0, "new_h": 2}), ("echo", {"delay": 0}), ("morphology", {"kind": "open"}), ("quantize", {"colours": 1}), ("quantize", {"dither": "x"}), ("spectrogram", {"colours": "jet"})):
        spec = Job.from_json(json.dumps({"@out": {"all": [{"filter": name, "params": params, "input": {"from": "x"}}]}}))
        with pytest.raises(JobError):
            compile_job(spark, spec, lambda *_: samples)


def test_ports(spark):
    """A filter of several outputs runs once, its ports go to tracks of their own; a picture port goes on to an encoder."""
    from framelake.plans import job as plans
    from framelake.sources import images

    samples = spark.range(256).selectExpr("concat('s', id % 2) AS stream_key", "id AS ordinal", "sin(id / 3.0) AS value")
    built = []
    whole = plans.FILTERS["crossover"]
    plans.FILTERS["crossover"] = lambda frames, params: built.append(1) or whole(frames, params)
    try:
        band = {"filter": "crossover", "params": {"freq": 500}, "input": {"from": "x"}}
        out = compile_job(spark, Job.from_json(json.dumps({"@out": {"audio": [band, band | {"port": "high"}]}})), lambda *_: samples)["@out"]
    finally:
        plans.FILTERS["crossover"] = whole
    assert built == [1] and [tuple(r) for r in out.groupBy("track_no").count().orderBy("track_no").collect()] == [(0, 256), (1, 256)]
    picture = {"filter": "spectrogram", "params": {"width": 32, "hop": 16}, "port": "picture", "input": {"from": "x"}}
    coded = compile_job(spark, Job.from_json(json.dumps({"@out": {"video": [picture | {"codec": "bmp"}]}})), lambda *_: samples)["@out"].collect()
    assert {r.frame_no for r in coded} == {"s0", "s1"} and {r.codec_id for r in coded} == {"bmp"}
    shape = images.read_bmp(bytes(coded[0].data)).shape
    assert shape == (17, 16, 3)


def test_colour_maps(spark):
    from framelake.functions.pixel import colour_of

    known = {"viridis": {0.0: (68, 1, 84), 0.5: (33, 145, 140), 1.0: (253, 231, 37)}, "magma": {0.0: (0, 0, 4), 0.5: (183, 55, 121), 1.0: (252, 253, 191)}}
    for name, colours in known.items():
        for level, want in colours.items():
            got = spark.range(1).select(*colour_of(F.lit(level), name)).first()
            assert all(abs(255 * g - w) < 5 for g, w in zip(got, want)), (name, level, [255 * g for g in got])


def test_convert_commands(spark):
    from framelake.plans.convert import parse_convert
    from framelake.sources import images

    job = parse_convert("in.png -resize 4x2 -blur 0x1.5 -edge 1 -dither FloydSteinberg -colors 4 -strip -quality 80 out.bmp", (8, 6))
    assert [x.strip() for x in job.to_dag().describe().split("\n")] == [
        "output: out.bmp", "mux(out.bmp)", "encode(bmp) {'quality': 80}", "filter(pixels)", "filter(strip)", "filter(quantize) {'colours': 4, 'dither': 'diffusion'}", "filter(edge)", "filter(blur) {'sigma': 1.5}",
        "filter(resize) {'h': 6, 'kind': 'bilinear', 'new_h': 2, 'new_w': 4, 'w': 8}", "demuxer(in.png)",
    ]
    for bad, said in (("a -rotate 90 b.bmp", "-rotate: not yet implemented"), ("a -crop 1x1 b.bmp", "-crop: not yet"), ("a -flip b.bmp", "-flip: not yet"), ("a -resize big b.bmp", "-resize: cannot take big"), ("a -colors b.bmp", "-colors: needs a value"), ("a b.xyz", "no codec"), ("a", "needs an input"), ("a -dither blue b.bmp", "cannot take blue"), ("a -blur 0x0 b.bmp", "cannot take 0x0")):
        with pytest.raises(JobError, match=re.escape(said)):
            parse_convert(bad, (2, 2))
    pixels = spark.range(48).selectExpr("7L AS frame_no", "cast(id % 8 AS int) AS x", "cast(id div 8 AS int) AS y", "id / 47.0D AS value", "'extra' AS note")
    row = compile_job(spark, job, lambda *_: pixels)["out.bmp"].first()
    back = images.read_bmp(bytes(row.data))
    assert back.shape == (2, 4, 3) and set(back.ravel().tolist()) <= {0, 85, 170, 255}
    pointwise = compile_job(spark, parse_convert("a -colors 9 -dither ordered -colors 5 -strip @null", (8, 6)), lambda *_: pixels)["@null"]
    plan = pointwise._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Project") <= 2


def test_pixels_are_converted_there_and_back(spark):
    from framelake.plans.job import convert_pixels

    rows = [(0, i % 4, i // 4, "rgb24", [(i * 37) % 256, (i * 91) % 256, (i * 53) % 256]) for i in range(16)]
    pixels = spark.createDataFrame(rows, "frame_no long, x int, y int, pixel_format string, stored array<int>")
    at = lambda df: {(r.x, r.y): r.stored for r in df.collect()}
    first = at(pixels)
    for name, most in (("bgr24", 0), ("rgba", 0), ("bgra", 0), ("rgb48le", 0), ("yuv444p", 2)):
        back = at(convert_pixels(convert_pixels(pixels, name), "rgb24"))
        assert all(max(abs(a - b) for a, b in zip(back[k], first[k])) <= most for k in first), name
    assert at(convert_pixels(pixels, "bgra"))[0, 1] == [*first[0, 1][::-1], 255]
    assert at(convert_pixels(pixels, "rgb48le"))[1, 0] == [257 * v for v in first[1, 0]]
    nv21, nv12 = at(convert_pixels(pixels, "nv21")), at(convert_pixels(pixels, "nv12"))
    assert all(nv21[k] == [nv12[k][0], nv12[k][2], nv12[k][1]] for k in first)
    wide = at(convert_pixels(pixels, "yuv422p"))
    assert wide[0, 0][1:] == wide[1, 0][1:] and nv12[0, 0][1:] == nv12[1, 1][1:]
    assert at(convert_pixels(convert_pixels(pixels, "yuv420p"), "yuv420p")) == at(convert_pixels(pixels, "yuv420p"))
    with pytest.raises(JobError, match="no conversion to pal8"):
        convert_pixels(pixels, "pal8")


def test_a_conversion_is_inserted_when_the_job_is_compiled(spark):
    from framelake.sources import images

    pixels = spark.createDataFrame([(0, 0, 0, "gray8", [7])], "frame_no long, x int, y int, pixel_format string, stored array<int>")
    spec = Job.from_json(json.dumps({"@out": {"video": [{"codec": "bmp", "from": "x"}]}}))
    row = compile_job(spark, spec, lambda *_: pixels, {"x": "gray8"})["@out"].first()
    assert (row.codec_id, row.pixel_format) == ("bmp", "rgb24")
    assert images.read_bmp(bytes(row.data)).ravel().tolist() == [7, 7, 7]
    with pytest.raises(Exception, match="bmp does not take gray8"):
        compile_job(spark, spec, lambda *_: pixels)["@out"].collect()


def test_payloads_by_job(spark):
    from framelake.plans.job import decode_payloads

    frames = spark.createDataFrame([(0, [0.5, -0.25, 1.5]), (1, None)], "frame_no long, samples array<double>")
    spec = Job.from_json(json.dumps({"@out": {"audio": [{"codec": "pcm_s16le", "from": "x"}]}}))
    out = compile_job(spark, spec, lambda *_: frames)["@out"]
    assert [r.data for r in out.orderBy("frame_no").collect()] == [bytes.fromhex("004000e0ff7f"), None]
    assert [r.samples for r in decode_payloads(out).orderBy("frame_no").collect()] == [[0.5, -0.25, 32767 / 32768], None]


def test_every_filter_runs_by_name(spark):
    from framelake.plans.job import FILTERS

    samples = spark.range(300).selectExpr("'s' AS stream_key", "id AS ordinal", "sin(id / 5.0) AS value", "true AS keyframe")
    pixels = spark.range(30).selectExpr("0L AS frame_no", "cast(id % 6 AS int) AS x", "cast(id div 6 AS int) AS y", "cast(id AS double) AS value")
    params = {"resize": {"w": 6, "h": 5, "new_w": 3, "new_h": 2}, "resample": {"source_rate": 100, "target_rate": 50}, "spectrogram": {"width": 64, "hop": 32}}
    for name in set(FILTERS) - {"decode"}:
        source = pixels if name in ("blur", "edge", "resize", "morphology", "quantize", "strip", "pixels", "gabor", "niblack") else samples
        spec = Job.from_json(json.dumps({"@out": {"all": [{"filter": name, "params": params.get(name, {}), "input": {"from": "x"}}]}}))
        assert compile_job(spark, spec, lambda *_, s=source: s)["@out"].count() > 0, name
    bad = Job.from_json(json.dumps({"@out": {"all": [{"filter": "echo", "params": {"dleay": 3}, "input": {"from": "x"}}]}}))
    with pytest.raises(JobError, match="unknown parameter dleay"):
        compile_job(spark, bad, lambda *_: samples)


def test_filters_after_a_resize_know_the_size(spark):
    """With the size, as without it: on a picture with a hole, and where no resize tells it."""
    from framelake.operators import filters
    from framelake.plans.job import size_at

    pixels = spark.range(48).where("id <> 17").selectExpr("7L AS frame_no", "cast(id % 8 AS int) AS x", "cast(id div 8 AS int) AS y", "id * id / 47.0D AS value")
    at = lambda df: {(r.x, r.y): round(r.value, 9) for r in df.collect()}
    taps = filters.gaussian(1.2)
    for one in ([taps], [[t] for t in taps], filters.BOX_BLUR):
        assert at(filters.convolve(pixels, "frame_no", one, size=(8, 6))) == at(filters.convolve(pixels, "frame_no", one))
    assert at(filters.edges(pixels, "frame_no", (8, 6))) == at(filters.edges(pixels, "frame_no")) and len(at(pixels)) == 47

    resize = {"filter": "resize", "params": {"w": 8, "h": 6, "new_w": 5, "new_h": 9, "kind": "bilinear"}, "input": {"from": "x"}}
    edge = lambda below: {"filter": "edge", "input": {"filter": "quantize", "input": below}}
    for tree, size in ((edge(resize), (5, 9)), (edge({"from": "x"}), None), (edge({"filter": "volume", "input": resize}), None)):
        assert size_at(Job({"@out": {"video": [tree]}}).to_dag().roots["@out"]) == size
    got = compile_job(spark, Job({"@out": {"video": [edge(resize)]}}), lambda *_: pixels)["@out"]
    small = filters.resize(pixels, "frame_no", 8, 6, 5, 9, "bilinear")
    known = compile_job(spark, Job({"@out": {"video": [edge({"from": "x"})]}}), lambda *_: small)["@out"]
    assert at(got) == at(known) and len(at(got)) == 45
    with pytest.raises(JobError, match="size of 5 x 0"):
        compile_job(spark, Job({"@out": {"video": [{"filter": "blur", "params": {"w": 5}, "input": {"from": "x"}}]}}), lambda *_: pixels)


def test_an_alias_gives_a_track_its_own_media_type(spark):
    frames = spark.createDataFrame([("Audio", 1), ("Video", 2)], "media_type string, n int")
    spec = Job.from_json(json.dumps({"@in": {"all": [{"from": "x"}]}, "a": {"audio": [{"from": "@in"}]}, "b": {"all": [{"from": "@in"}]}}))
    built = compile_job(spark, spec, lambda *_: frames)
    assert [r.n for r in built["a"].collect()] == [1] and built["b"].count() == 2


def test_a_job_runs_into_its_sinks(spark, tmp_path):
    from framelake.plans.job import run_job
    from framelake.streaming.stateful import Sink

    calls = []

    class Probe(Sink):
        def __init__(self, fail=False):
            self.fail = fail

        def start(self, columns):
            calls.append(("start", columns))

        def write(self, batch, batch_id):
            if self.fail:
                raise RuntimeError("the sink gave up")
            calls.append(("write", batch.count()))

        def finish(self):
            calls.append(("finish",))

    frames = spark.range(6).selectExpr("id AS n")
    track, first, second = {"all": [{"from": "x"}]}, str(tmp_path / "first"), str(tmp_path / "second")
    made = Job.from_json(json.dumps({first: track, "@out": track, "@null": track}))
    assert run_job(spark, made, lambda *_: frames, {"@out": Probe()}) == [first, "@out", "@null"]
    assert calls == [("start", ["n", "track_no"]), ("write", 6), ("finish",)] and spark.read.parquet(first).count() == 6
    del calls[:]
    with pytest.raises(RuntimeError, match="gave up"):
        run_job(spark, Job.from_json(json.dumps({"@null": track, second: track})), lambda *_: frames, {"@null": Probe(fail=True)})
    assert calls == [("start", ["n", "track_no"])] and not (tmp_path / "second").exists()
    with pytest.raises(JobError, match="@sink: only"):
        run_job(spark, made, lambda *_: frames, {"@sink": Probe()})
    with pytest.raises(JobError, match="@out: needs a sink"):
        run_job(spark, made, lambda *_: frames)


def test_a_job_in_the_background(spark, tmp_path):
    from framelake.plans.job import spawn_job

    track, path = {"all": [{"from": "x"}]}, str(tmp_path / "out")
    handle = spawn_job(spark, Job.from_json(json.dumps({path: track, "@null": track})), lambda *_: spark.range(40, numPartitions=4))
    assert handle.wait(120) == [path, "@null"]
    progress = handle.progress()
    assert progress["state"] == "finished" and progress["outputs"] == [path, "@null"] and progress["tasks_done"] == progress["tasks"] >= 8
    handle.abort()
    assert handle.progress()["state"] == "finished" and spark.read.parquet(path).count() == 40
    failing = spawn_job(spark, Job.from_json(json.dumps({"@out": track})), lambda *_: spark.range(3))
    with pytest.raises(JobError, match="needs a sink"):
        failing.wait(60)
    assert failing.progress()["state"] == "failed"


def test_a_job_is_aborted(spark):
    """Running tasks are stopped, and the output after them does not start."""
    import time

    from framelake.plans.job import JobAborted, spawn_job

    def slow(batches):
        for batch in batches:
            time.sleep(60)
            yield batch

    frames = spark.range(4, numPartitions=2).mapInArrow(slow, "id long")
    track = {"all": [{"from": "x"}]}
    handle = spawn_job(spark, Job.from_json(json.dumps({"@null": track, "/nowhere/else": track})), lambda *_: frames)
    for _ in range(100):
        if handle.progress()["tasks"]:
            break
        time.sleep(0.1)
    with pytest.raises(TimeoutError):
        handle.wait(0.1)
    start = time.monotonic()
    handle.abort()
    with pytest.raises(JobAborted):
        handle.wait(50)
    assert time.monotonic() - start < 50
    progress = handle.progress()
    assert progress["state"] == "aborted" and progress["outputs"] == ["@null"]
    assert spark.range(3).count() == 3


def test_limited_halves(spark):
    """A luma of 0.625 is 611.5 in ten limited bits, and rounds up."""
    from framelake.plans.job import convert_pixels

    pixels = spark.createDataFrame([(0, 0, 0, "rgb24", [132, 175, 102])], "frame_no long, x int, y int, pixel_format string, stored array<int>")
    assert convert_pixels(pixels, "p010le", "bt2020", True).first().stored[0] == 612 << 6


def test_deep_formats_matrices_and_ranges(spark):
    """There and back within a step, under every matrix and range; black and white where they belong."""
    from framelake.functions.pixel import MATRICES, STORED, top_value, value_step
    from framelake.plans.job import convert_pixels

    rows = [(0, i % 4, i // 4, "rgb24", [(i * 37) % 256, (i * 91) % 256, (i * 53) % 256]) for i in range(16)] + [(1, 0, 0, "rgb24", [0, 0, 0]), (1, 2, 2, "rgb24", [255, 255, 255])]
    pixels = spark.createDataFrame(rows, "frame_no long, x int, y int, pixel_format string, stored array<int>")
    at = lambda df: {(r.frame_no, r.x, r.y): r.stored for r in df.collect()}
    first = at(pixels)
    for matrix in MATRICES:
        for limited in (False, True):
            deep = convert_pixels(pixels, "yuv444p16le", matrix, limited)
            back = at(convert_pixels(deep, "rgb24", from_matrix=matrix, from_limited=limited))
            assert all(max(abs(a - b) for a, b in zip(back[k], first[k])) <= (1 if matrix == "bt709" else 0) for k in first), (matrix, limited)
    for name, order in STORED.items():
        got = at(convert_pixels(pixels, name))
        assert all(len(v) == len(order) and all(0 <= x <= top_value(name) * value_step(name) and x % value_step(name) == 0 for x in v) for v in got.values())
    ten = at(convert_pixels(pixels, "p010le", "bt2020", True))
    assert ten[1, 0, 0] == [64 << 6, 512 << 6, 512 << 6] and ten[1, 2, 2] == [940 << 6, 512 << 6, 512 << 6]
    changed = at(convert_pixels(convert_pixels(pixels, "yuv444p"), "yuv444p", limited=True))
    assert changed[1, 2, 2] == [235, 128, 128]
    with pytest.raises(JobError, match="unknown matrix bt470"):
        Job.from_json(json.dumps({"o": {"all": [{"convert": "nv12", "matrix": "bt470", "input": {"from": "x"}}]}})).validate()
    with pytest.raises(JobError, match="unknown from_range tv"):
        Job.from_json(json.dumps({"o": {"all": [{"convert": "nv12", "from_range": "tv", "input": {"from": "x"}}]}})).validate()
