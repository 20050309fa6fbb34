"""Declarative job graphs: JSON text to a checked graph to DataFrames.

A job maps output keys to groups of tracks (audio, video, subtitle, all); a track
is a tree of nodes: {"from": address or "@alias"}, {"filter", "params", "input"},
{"convert", "input"}, optionally with "codec" at its root.  A filter of several
outputs gives the first one, or the one that "port" names.  Keys that start with
@ are aliases unless they name a sink (@null, @display, @out).

No node only labels rows: an encode needs an encoder, or packets that carry the codec
already; a convert needs pixels.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField, StructType
from pyspark.status import SparkJobInfo

from ..functions.pixel import COLOUR_MAPS, MATRICES, PIXEL_FORMATS, SHARED_CHROMA, STORED, bayer_level, colour_of, rgb_of, stored_of, unit_values, value_step
from ..operators import filters, pictures
from ..sources import images
from ..sources.codecs import register_all
from ..streaming.stateful import Sink

SINKS = ("@null", "@display", "@out")
GROUPS = ("audio", "video", "subtitle", "all")
FILTERS: dict[str, Callable[[DataFrame, dict], DataFrame | dict[str, DataFrame]]] = {}
#: The outputs of filters that have several, the first of them the usual one.
PORTS: dict[str, tuple[str, ...]] = {}
#: Filters that take the size of pictures, w and h, where it is known, and others that leave it as it is.
SIZED, SAME_SIZE = ("blur", "edge"), ("strip", "pixels", "gabor", "niblack", "quantize", "morphology")
REGISTRY = register_all()
_NO_STAGES = SparkJobInfo(-1, [], "UNKNOWN")


class JobError(ValueError):
    """A job that cannot be accepted; the message names the output and the value."""


def filter_named(name: str, *ports: str) -> Callable:
    """Registers a filter (frames, params) -> frames, or a dict of frames by port, under a name."""

    def add(f: Callable[[DataFrame, dict], DataFrame | dict[str, DataFrame]]) -> Callable:
        FILTERS[name] = f
        if ports:
            PORTS[name] = ports
        return f

    return add


#: Columns by which filters know a stream of samples, and a picture.
STREAM, ORDER, PICTURE = "stream_key", "ordinal", "frame_no"


def _numbers(params: dict, **defaults: float) -> dict:
    """The parameters that a filter knows, as numbers of its defaults' kind; others are an error."""
    unknown = sorted(set(params) - set(defaults))
    if unknown:
        raise JobError(f"unknown parameter {unknown[0]}")
    out = {}
    for name, value in defaults.items():
        try:
            out[name] = type(value)(params.get(name, value))
        except (TypeError, ValueError) as e:
            raise JobError(f"parameter {name} is no number: {params[name]!r}") from e
    return out


@filter_named("noise_gate")
def _noise_gate(frames: DataFrame, params: dict) -> DataFrame:
    return filters.noise_gate(frames, STREAM, ORDER, **_numbers(params, threshold=0.05, attack=4, hold=16, release=16))


@filter_named("echo")
def _echo(frames: DataFrame, params: dict) -> DataFrame:
    given = _numbers(params, delay=1, mix=0.5, feedback=0.0)
    if given["delay"] < 1:
        raise JobError(f"a delay of {given['delay']} samples is too short")
    return filters.echo(frames, STREAM, ORDER, **given)


@filter_named("resample")
def _resample(frames: DataFrame, params: dict) -> DataFrame:
    rates = _numbers(params, source_rate=48_000, target_rate=44_100, half=16)
    return filters.resample(frames.select(STREAM, ORDER, "value"), STREAM, ORDER, **rates)


@filter_named("spectrogram", "bins", "samples", "picture")
def _spectrogram(frames: DataFrame, params: dict) -> dict[str, DataFrame]:
    """Powers, the samples as they came, and a picture a stream: time to the right, low notes below, decibels as colours."""
    colours, floor = params.get("colours", "viridis"), _numbers({k: v for k, v in params.items() if k == "floor"}, floor=-80.0)["floor"]
    if colours not in COLOUR_MAPS:
        raise JobError(f"unknown colours {colours}")
    sizes = _numbers({k: v for k, v in params.items() if k not in ("colours", "floor")}, width=256, hop=128)
    bins = filters.spectrogram(frames, STREAM, ORDER, **sizes)
    loud = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - 10 * F.log10(F.greatest("power", F.lit(1e-30)) / (sizes["width"] / 4) ** 2) / floor))
    stored = F.array(*(F.round(c * 255).cast("int") for c in colour_of(loud, colours)))
    picture = bins.select(F.col(STREAM).alias(PICTURE), F.col("frame").cast("int").alias("x"), (sizes["width"] // 2 - F.col("bin")).cast("int").alias("y"), F.lit("rgb24").alias("pixel_format"), stored.alias("stored"))
    return {"bins": bins, "samples": frames, "picture": picture}


def _split_bands(frames: DataFrame, params: dict) -> dict[str, DataFrame]:
    found = filters.crossover(frames, STREAM, ORDER, **_numbers(params, freq=1000.0, rate=48_000.0))
    return {port: found.select(STREAM, ORDER, F.col(port).alias("value")) for port in ("low", "high")}


def _split_state(frames: DataFrame, params: dict) -> dict[str, DataFrame]:
    found = filters.state_variable(frames, STREAM, ORDER, **_numbers(params, freq=1000.0, rate=48_000.0, q=0.7071))
    return {port: found.select(STREAM, ORDER, F.col(port).alias("value")) for port in ("low", "band", "high")}


filter_named("crossover", "low", "high")(_split_bands)
filter_named("state_variable", "low", "band", "high")(_split_state)


def _section(kind: str) -> Callable[[DataFrame, dict], DataFrame]:
    return lambda frames, params: filters.biquad(frames, STREAM, ORDER, kind, **_numbers(params, freq=1000.0, rate=48_000.0, q=0.7071, gain_db=0.0))


for _kind in ("lowpass", "highpass", "bandpass", "notch", "allpass", "peak", "lowshelf", "highshelf"):
    filter_named(_kind)(_section(_kind))


def _size(given: dict) -> tuple[int, int] | None:
    """(width, height) of pictures, or null where a job does not say it."""
    if given["w"] < 0 or given["h"] < 0 or (given["w"] > 0) != (given["h"] > 0):
        raise JobError(f"a size of {given['w']} x {given['h']} is none")
    return (given["w"], given["h"]) if given["w"] else None


@filter_named("blur")
def _blur(frames: DataFrame, params: dict) -> DataFrame:
    """A box of nine pixels, or a Gaussian of ``sigma``, along rows and then columns."""
    given = _numbers(params, sigma=0.0, w=0, h=0)
    size = _size(given)
    if given["sigma"] == 0:
        return filters.convolve(frames, PICTURE, filters.BOX_BLUR, size=size)
    taps = filters.gaussian(given["sigma"])
    return filters.convolve(filters.convolve(frames, PICTURE, [taps], size=size), PICTURE, [[t] for t in taps], size=size)


@filter_named("gabor")
def _gabor(frames: DataFrame, params: dict) -> DataFrame:
    return filters.convolve(frames, PICTURE, filters.gabor(**_numbers(params, wavelength=4.0, theta=0.0, sigma=1.0, phase=0.0)))


@filter_named("niblack")
def _niblack(frames: DataFrame, params: dict) -> DataFrame:
    return filters.niblack(frames, PICTURE, **_numbers(params, reach=1, k=-0.2))


@filter_named("quantize")
def _quantize(frames: DataFrame, params: dict) -> DataFrame:
    """Values of 0 to 1 in ``colours`` even steps: by rounding, an ordered pattern or diffused errors."""
    dither = params.get("dither", "none")
    levels = _numbers({k: v for k, v in params.items() if k != "dither"}, colours=256)["colours"]
    if levels < 2:
        raise JobError(f"{levels} colours are too few")
    if dither == "diffusion":
        return pictures.error_diffusion(frames, PICTURE, levels).select(PICTURE, "x", "y", (F.col("step") / (levels - 1)).alias("value"))
    steps = {"none": filters.uniform_palette(F.col("value"), levels), "ordered": bayer_level(F.col("value"), F.col("x"), F.col("y"), levels)}
    if dither not in steps:
        raise JobError(f"unknown dither {dither}")
    return frames.withColumn("value", steps[dither] / (levels - 1))


@filter_named("edge")
def _edge(frames: DataFrame, params: dict) -> DataFrame:
    return filters.edges(frames, PICTURE, _size(_numbers(params, w=0, h=0)))


@filter_named("resize")
def _resize(frames: DataFrame, params: dict) -> DataFrame:
    kind = params.get("kind", "nearest")
    if kind != "nearest" and kind not in filters.KERNELS:
        raise JobError(f"unknown kernel {kind}")
    sizes = _numbers({k: v for k, v in params.items() if k != "kind"}, w=0, h=0, new_w=0, new_h=0)
    for name, size in sizes.items():
        if size < 1:
            raise JobError(f"resize needs {name}, not {size}")
    return filters.resize(frames, PICTURE, **sizes, kind=kind)


@filter_named("morphology")
def _morphology(frames: DataFrame, params: dict) -> DataFrame:
    kind = params.get("kind", "dilate")
    if kind not in ("dilate", "erode"):
        raise JobError(f"unknown kind {kind}")
    return filters.morphology(frames, PICTURE, kind, **_numbers({k: v for k, v in params.items() if k != "kind"}, reach=1))


@filter_named("volume")
def _volume(frames: DataFrame, params: dict) -> DataFrame:
    given = _numbers(params, scale=1.0, gain_db=0.0)
    scale = given["scale"] if "scale" in params else 10 ** (given["gain_db"] / 20)
    return frames.withColumn("value", F.col("value") * scale)


@filter_named("keyframes")
def _keyframes(frames: DataFrame, params: dict) -> DataFrame:
    return frames.where("keyframe")


@dataclass(frozen=True)
class Node:
    kind: str
    value: str
    params: tuple = ()
    inputs: tuple[Node, ...] = ()
    group: str = "all"

    def lines(self, depth: int = 0) -> list[str]:
        shown = f"{self.kind}({self.value})" + (f" {dict(self.params)}" if self.params else "")
        return ["  " * depth + shown, *(line for i in self.inputs for line in i.lines(depth + 1))]


@dataclass
class Dag:
    roots: dict[str, Node] = field(default_factory=dict)

    def describe(self) -> str:
        return "\n".join(line for key, root in self.roots.items() for line in [f"output: {key}", *root.lines(1)])


class Job:
    def __init__(self, outputs: dict[str, dict], threads: int = 0):
        self.outputs, self.threads = outputs, threads

    @classmethod
    def from_json(cls, text: str) -> Job:
        try:
            raw = json.loads(text)
        except ValueError as e:
            raise JobError(f"job is not JSON: {e}") from e
        if not isinstance(raw, dict):
            raise JobError("job is not an object")
        threads = raw.pop("threads", 0)
        if not isinstance(threads, int):
            raise JobError(f"threads is no number: {threads!r}")
        return cls(raw, threads)

    @property
    def sinks(self) -> list[str]:
        return [k for k in self.outputs if not k.startswith("@") or k in SINKS]

    def _resolve(self, key: str, tree: dict, group: str, path: tuple[str, ...]) -> Node:
        if not isinstance(tree, dict):
            raise JobError(f"{key}: a track is not an object: {tree!r}")
        below = lambda: self._resolve(key, tree.get("input", {}), group, path)
        if "convert" in tree:
            if str(tree["convert"]).lower() not in PIXEL_FORMATS:
                raise JobError(f"{key}: unknown pixel format {tree['convert']}")
            colours = tuple((name, tree[name]) for name in ("matrix", "range", "from_matrix", "from_range") if name in tree)
            for name, value in colours:
                if value not in (MATRICES if name.endswith("matrix") else ("full", "limited")):
                    raise JobError(f"{key}: unknown {name} {value}")
            node = Node("convert", str(tree["convert"]).lower(), colours, (below(),), group)
        elif "filter" in tree:
            name = self._text(key, tree, "filter")
            if name not in FILTERS:
                raise JobError(f"{key}: unknown filter {name}")
            node = Node("filter", name, self._params(key, tree, "params"), (below(),), group)
            ports = PORTS.get(name, ())
            if "port" in tree and tree["port"] not in ports:
                raise JobError(f"{key}: {name} has no port {tree['port']}")
            if ports:
                node = Node("port", tree.get("port", ports[0]), inputs=(node,), group=group)
        elif "from" in tree:
            source = self._text(key, tree, "from")
            if source.startswith("@"):
                if source in path:
                    raise JobError(f"{key}: alias cycle {' -> '.join((*path, source))}")
                if source not in self.outputs:
                    raise JobError(f"{key}: unknown alias {source}")
                node = Node("alias", source, inputs=self._tracks(source, (*path, source)), group=group)
            else:
                node = Node("demuxer", source, group=group)
        else:
            raise JobError(f"{key}: a track needs from, filter or convert: {tree!r}")
        if "codec" in tree:
            node = Node("encode", self._text(key, tree, "codec"), self._params(key, tree, "codec_params"), (node,), group)
        return node

    @staticmethod
    def _text(key: str, tree: dict, name: str) -> str:
        if not isinstance(tree[name], str):
            raise JobError(f"{key}: {name} is no text: {tree[name]!r}")
        return tree[name]

    @staticmethod
    def _params(key: str, tree: dict, name: str) -> tuple:
        """Parameters in the order of their names; lists become tuples, so that nodes can be compared."""
        given = tree.get(name, {})
        if not isinstance(given, dict):
            raise JobError(f"{key}: {name} is not an object: {given!r}")

        def fixed(value: object) -> object:
            if isinstance(value, dict):
                raise JobError(f"{key}: {name} holds an object: {value!r}")
            return tuple(map(fixed, value)) if isinstance(value, list) else value

        return tuple((k, fixed(v)) for k, v in sorted(given.items()))

    def _tracks(self, key: str, path: tuple[str, ...]) -> tuple[Node, ...]:
        groups = self.outputs[key]
        if not isinstance(groups, dict):
            raise JobError(f"{key}: not an object")
        for group, tracks in groups.items():
            if group not in GROUPS:
                raise JobError(f"{key}: unknown track group {group}")
            if not isinstance(tracks, list):
                raise JobError(f"{key}: {group} is no list of tracks: {tracks!r}")
        return tuple(self._resolve(key, track, group, path) for group, tracks in groups.items() for track in tracks)

    def to_dag(self) -> Dag:
        """The checked graph; aliases are walked too, so that a cycle among them is found."""
        roots = {}
        for key in self.outputs:
            tracks = self._tracks(key, (key,) if key.startswith("@") else ())
            if key in self.sinks:
                if not tracks:
                    raise JobError(f"{key}: has no track")
                roots[key] = Node("mux", key, inputs=tracks)
        if not roots:
            raise JobError("job has no output")
        return Dag(roots)

    def validate(self) -> str:
        return f"OK: {len(self.to_dag().roots)} output(s)"


def format_at(node: Node, source_formats: dict[str, str]) -> str | None:
    """The pixel format that leaves a node, or null where nobody knows it."""
    if node.kind == "convert":
        return node.value
    if node.kind == "demuxer":
        return source_formats.get(node.value)
    found = {format_at(i, source_formats) for i in node.inputs}
    return found.pop() if len(found) == 1 else None


def size_at(node: Node) -> tuple[int, int] | None:
    """(width, height) of the pictures that leave a node: what the last resize made, or null where there is none."""
    if node.kind == "filter" and node.value == "resize":
        made = dict(node.params)
        return int(made["new_w"]), int(made["new_h"])
    if node.kind in ("demuxer", "port") or node.kind == "filter" and node.value not in SIZED + SAME_SIZE:
        return None
    found = {size_at(i) for i in node.inputs}
    return found.pop() if len(found) == 1 else None


def insert_conversions(dag: Dag, accepted: dict[str, tuple[str, ...]], formats: Callable[[Node], str | None]) -> Dag:
    """Adds a convert below an encoder that does not accept what reaches it."""

    def visit(node: Node) -> Node:
        inputs = tuple(map(visit, node.inputs))
        if node.kind == "encode" and node.value in accepted and formats(inputs[0]) not in (None, *accepted[node.value]):
            inputs = (Node("convert", accepted[node.value][0], inputs=inputs, group=node.group),)
        return Node(node.kind, node.value, node.params, inputs, node.group)

    return Dag({k: visit(n) for k, n in dag.roots.items()})


def convert_pixels(frames: DataFrame, target: str, matrix: str = "bt709", limited: bool = False, from_matrix: str = "bt709", from_limited: bool = False) -> DataFrame:
    """Rows (picture, x, y, pixel_format, stored array<int>) in another format.

    Each order of values is one branch of an expression.  Formats that share chroma
    take the mean of the pixels that share it, one window over small squares.  Matrix and
    range count for luma and chroma, on either side; rows that are in the target format
    already stay as they are if neither changes.
    """
    if target not in STORED:
        raise JobError(f"no conversion to {target}")
    same = (matrix, limited) == (from_matrix, from_limited)
    rows = frames.withColumns({"_was": F.col("pixel_format"), "_stored": F.col("stored")})  # names that no column below takes again
    source = F.transform(F.array(unit_values(F.col("_stored"), F.col("_was"), from_limited)), lambda unit: rgb_of(unit, from_matrix, (from_matrix, from_limited) != ("bt709", False)))
    stored = F.get(F.transform(source, lambda c: stored_of([c[x] for x in "rgba"], target, matrix, limited)), 0)
    stored = F.when((F.col("_was") == target) & F.lit(same), F.col("_stored")).when(F.col("_was").isin(*STORED), stored)
    out = rows.withColumns({"stored": stored, "pixel_format": F.lit(target)})
    if target in SHARED_CHROMA and {PICTURE, "x", "y"} <= set(out.columns):
        wide, high = SHARED_CHROMA[target]
        square = Window.partitionBy(PICTURE, F.floor(F.col("x") / wide), F.floor(F.col("y") / high))
        step = value_step(target)
        shared = F.array(F.get("stored", 0), *(F.round(F.avg(F.get("stored", i)).over(square) / step).cast("int") * step for i in (1, 2)))
        out = out.withColumn("stored", F.when((F.col("_was") == target) & F.lit(same), F.col("stored")).otherwise(shared))
    return out.drop("_was", "_stored")


def encode_samples(frames: DataFrame, codec: str) -> DataFrame:
    """frames with samples array in a codec's payload: data binary in their place."""
    encode = REGISTRY.resolve(codec, "encode").encode
    at = frames.columns.index("samples")
    names = [*frames.columns[:at], *frames.columns[at + 1 :], "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if s is None else encode(np.array(s, np.float64)) for s in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(data, pa.binary())], names=names)

    return frames.mapInArrow(run, StructType([*(f for f in frames.schema.fields if f.name != "samples"), StructField("data", BinaryType())]))


def encode_pictures(frames: DataFrame, codec: str) -> DataFrame:
    """Pixel rows as one payload a picture: (PICTURE, pixel_format, data); formats that the codec does not take stop the job."""
    accepted = next(c.accepted for c in REGISTRY.impls if c.codec == codec)
    known = F.when(F.col("pixel_format").isin(*accepted), F.col("pixel_format")).otherwise(F.raise_error(F.concat(F.lit(f"{codec} does not take "), F.coalesce("pixel_format", F.lit("pixels of no format")))))
    rows = frames.select(PICTURE, "x", "y", known.alias("pixel_format"), "stored")
    grouped = rows.groupBy(PICTURE, "pixel_format").agg(F.sort_array(F.collect_list(F.struct("y", "x", "stored"))).alias("_p"))
    last = F.element_at("_p", -1)
    flat = grouped.select(F.struct(PICTURE, "pixel_format").alias("uri"), (last["x"] + 1).cast("int").alias("width"), (last["y"] + 1).cast("int").alias("height"), F.size(last["stored"]).alias("channels"), F.lit(8).alias("depth"), F.flatten(F.transform("_p", lambda p: p["stored"])).alias("pixels"))
    texts = flat.withColumn("uri", F.to_json("uri"))
    kinds = flat.schema["uri"].dataType
    return images.encode(texts, codec).select(F.from_json("uri", kinds).alias("u"), "data").select("u.*", "data")


def decode_payloads(frames: DataFrame) -> DataFrame:
    """The way back, by each row's codec_id: samples array<double> in place of data."""
    at, by = frames.columns.index("data"), frames.columns.index("codec_id")
    names = [*(c for c in frames.columns if c != "data"), "samples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = [None if d is None else REGISTRY.resolve(codec, "decode").decode(d).astype(np.float64) for codec, d in zip(batch.column(by).to_pylist(), batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(samples, pa.list_(pa.float64()))], names=names)

    return frames.mapInArrow(run, StructType([*(f for f in frames.schema.fields if f.name != "data"), StructField("samples", ArrayType(DoubleType()))]))


@filter_named("decode")
def _decode(frames: DataFrame, params: dict) -> DataFrame:
    return decode_payloads(frames)


def conversion_path(edges: dict[str, set[str]], source: str, target: str) -> list[str] | None:
    """Shortest chain of direct conversions, source and target included; None if there is none."""
    paths, seen = [[source]], {source}
    while paths:
        path = paths.pop(0)
        if path[-1] == target:
            return path
        for step in sorted(edges.get(path[-1], set()) - seen):
            seen.add(step)
            paths.append([*path, step])
    return None


def compile_job(spark: SparkSession, job: Job, read: Callable[[SparkSession, str], DataFrame], source_formats: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """One lazy DataFrame per output; an alias is compiled once, and unrequested media types are filtered at the scan.

    source_formats: the pixel format of each address; where it is known, a convert is
    put before an encoder that does not accept what reaches it.
    """
    accepted = {c.codec: c.accepted for c in REGISTRY.impls if c.accepted}
    dag, memo = insert_conversions(job.to_dag(), accepted, lambda node: format_at(node, source_formats or {})), {}

    def encoded(frames: DataFrame, codec: str) -> DataFrame:
        """Payloads of the codec; packets that carry it already are copied, others stop the job."""
        made = any(c.codec == codec and c.encode is not None for c in REGISTRY.impls)
        if made and "samples" in frames.columns:
            return encode_samples(frames, codec).withColumn("codec_id", F.lit(codec))
        if made and {"stored", PICTURE, "x", "y"} <= set(frames.columns):
            return encode_pictures(frames, codec).withColumn("codec_id", F.lit(codec))
        if "codec_id" not in frames.columns:
            raise JobError(f"nothing can encode {codec} from ({', '.join(frames.columns)})")
        other = F.raise_error(F.concat(F.lit(f"nothing can encode {codec} from "), F.coalesce("codec_id", F.lit("rows of no codec"))))
        return frames.withColumn("codec_id", F.when(F.col("codec_id") == codec, F.col("codec_id")).otherwise(other))

    def build(node: Node) -> DataFrame | dict[str, DataFrame]:
        if node in memo:
            return memo[node]
        if node.kind == "demuxer":
            out = read(spark, node.value)
            if node.group != "all" and "media_type" in out.columns:
                out = out.where(F.lower("media_type") == node.group)
        elif node.kind in ("alias", "mux"):
            parts = [build(i).withColumn("track_no", F.lit(n)) for n, i in enumerate(node.inputs)]
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part, allowMissingColumns=True)
            if node.kind == "alias" and node.group != "all" and "media_type" in out.columns:
                out = out.where(F.lower("media_type") == node.group)
        elif node.kind == "filter":
            frames, params = build(node.inputs[0]), dict(node.params)
            size = size_at(node.inputs[0]) if node.value in SIZED else None
            out = FILTERS[node.value](frames, params | ({"w": size[0], "h": size[1]} if size else {}))
        elif node.kind == "port":
            out = build(node.inputs[0])[node.value]
        elif node.kind == "convert":
            frames = build(node.inputs[0])
            if "stored" not in frames.columns:
                raise JobError(f"a conversion to {node.value} needs pixels, not packets")
            colours = {"matrix": "bt709", "range": "full", "from_matrix": "bt709", "from_range": "full"} | dict(node.params)
            out = convert_pixels(frames, node.value, colours["matrix"], colours["range"] == "limited", colours["from_matrix"], colours["from_range"] == "limited")
        else:
            out = encoded(build(node.inputs[0]), node.value)
        memo[node] = out
        return out

    return {key: build(root) for key, root in dag.roots.items()}


class NullSink(Sink):
    """Runs the plan and keeps nothing."""

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.format("noop").mode("overwrite").save()


class ParquetSink(Sink):
    """A folder of Parquet files, replaced as a whole."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(self.path)


def run_job(spark: SparkSession, job: Job, read: Callable[[SparkSession, str], DataFrame], overrides: dict[str, Sink] | None = None, source_formats: dict[str, str] | None = None, between: Callable[[str], None] = lambda key: None) -> list[str]:
    """Runs every output into its sink, in the job's order, and returns their keys.

    An address is a folder of Parquet files and @null keeps nothing; overrides give
    sinks to reserved names, and @display and @out have none without one.  A sink's
    error stops the job: it is not finished, and later outputs do not start.
    ``between`` is called with each key before its output starts; it may raise.
    """
    overrides = overrides or {}
    for name in overrides:
        if name not in SINKS:
            raise JobError(f"{name}: only {', '.join(SINKS)} can be given a sink")
    built = compile_job(spark, job, read, source_formats)
    sinks = {key: overrides[key] if key in overrides else NullSink() if key == "@null" else None if key in SINKS else ParquetSink(key) for key in built}
    for key, sink in sinks.items():
        if sink is None:
            raise JobError(f"{key}: needs a sink of its own")
    for key, sink in sinks.items():
        between(key)
        sink.start(built[key].columns)
        sink.write(built[key], 0)
        sink.finish()
    return list(sinks)


class JobAborted(RuntimeError):
    """A job that was stopped from outside."""


class JobHandle:
    """A job in the background: its progress, its end, and a way to stop it.

    All Spark work of the job runs under one job group of its own.
    """

    def __init__(self, spark: SparkSession, work: Callable[[Callable[[str], None]], list[str]]):
        self._context, self.group = spark.sparkContext, f"framelake-{uuid.uuid4().hex}"
        self._started: list[str] = []
        self._aborted, self._result, self._error = False, None, None
        self._thread = InheritableThread(target=self._run, args=(work,), daemon=True)
        self._thread.start()

    def _run(self, work: Callable[[Callable[[str], None]], list[str]]) -> None:
        self._context.setJobGroup(self.group, "framelake job", interruptOnCancel=True)
        try:
            self._result = work(self._between)
        except BaseException as e:  # told to whoever waits
            self._error = e

    def _between(self, key: str) -> None:
        if self._aborted:
            raise JobAborted(f"aborted before {key}")
        self._started.append(key)

    def abort(self) -> None:
        """Stops running tasks; outputs that have not started do not start.  After the end it changes nothing."""
        if self._thread.is_alive():
            self._aborted = True
            self._context.cancelJobGroup(self.group)

    def progress(self) -> dict[str, object]:
        """state (running, finished, failed, aborted), the outputs that have started, and tasks done and in all of the group's stages."""
        tracker, done, total = self._context.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            for stage in (tracker.getJobInfo(job) or _NO_STAGES).stageIds:
                info = tracker.getStageInfo(stage)
                done, total = (done + info.numCompletedTasks, total + info.numTasks) if info else (done, total)
        alive = self._thread.is_alive()
        state = "running" if alive else "aborted" if self._aborted and self._error else "failed" if self._error else "finished"
        return {"state": state, "outputs": list(self._started), "tasks_done": done, "tasks": total}

    def wait(self, seconds: float | None = None) -> list[str]:
        """The job's keys; its error is raised here, as JobAborted if it was stopped."""
        self._thread.join(seconds)
        if self._thread.is_alive():
            raise TimeoutError("the job is still running")
        if self._error is not None and self._aborted:
            raise JobAborted("the job was aborted") from self._error
        if self._error is not None:
            raise self._error
        return self._result


def spawn_job(spark: SparkSession, job: Job, read: Callable[[SparkSession, str], DataFrame], overrides: dict[str, Sink] | None = None, source_formats: dict[str, str] | None = None) -> JobHandle:
    """run_job() in the background."""
    return JobHandle(spark, lambda between: run_job(spark, job, read, overrides, source_formats, between))
