"""Sources by scheme: bytes, packets, frames or titles as DataFrames."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from urllib.parse import unquote, unquote_to_bytes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import generate

BYTES = "uri string, data binary"


class Unsupported(ValueError):
    """A scheme, or a source shape, that has no reader here."""


_MEMORY: dict[str, bytes] = {}


def put_memory(name: str, data: bytes) -> str:
    """Registers bytes under mem://name."""
    _MEMORY[name] = data
    return f"mem://{name}"


def _one(spark: SparkSession, uri: str, data: bytes) -> DataFrame:
    return spark.createDataFrame([(uri, bytearray(data))], BYTES)


def _file(spark: SparkSession, uri: str) -> DataFrame:
    path = unquote(uri.removeprefix("file://"))
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), F.col("content").alias("data"))


def _memory(spark: SparkSession, uri: str) -> DataFrame:
    name = uri.removeprefix("mem://")
    if name not in _MEMORY:
        raise Unsupported(f"{uri}: nothing is stored under this name")
    return _one(spark, uri, _MEMORY[name])


def _data(spark: SparkSession, uri: str) -> DataFrame:
    head, _, body = uri.removeprefix("data:").partition(",")
    return _one(spark, uri, base64.b64decode(unquote(body)) if head.endswith(";base64") else unquote_to_bytes(body))


def _slice(spark: SparkSession, uri: str) -> DataFrame:
    m = re.fullmatch(r"slice:(\d+)\+(\d+)!(.*)", uri, re.S)
    if not m:
        raise Unsupported(f"{uri}: expected slice:<offset>+<length>!<source>")
    inner = open_uri(spark, m[3])
    return inner.select(F.lit(uri).alias("uri"), F.substring("data", int(m[1]) + 1, int(m[2])).alias("data"))


def _concat(spark: SparkSession, uri: str) -> DataFrame:
    parts = None
    for i, inner in enumerate(uri.removeprefix("concat:").split("|")):
        part = open_uri(spark, inner).select(F.lit(i).alias("i"), "data")
        parts = part if parts is None else parts.unionByName(part)
    joined = F.transform(F.array_sort(F.collect_list(F.struct("i", "data"))), lambda x: x["data"])
    return parts.agg(F.lit(uri).alias("uri"), F.aggregate(joined, F.lit(b""), lambda a, x: F.concat(a, x)).alias("data"))


READERS: dict[str, tuple[str, Callable[[SparkSession, str], DataFrame]]] = {
    "file": ("bytes", _file),
    "mem": ("bytes", _memory),
    "data": ("bytes", _data),
    "slice": ("bytes", _slice),
    "concat": ("bytes", _concat),
    "generate": ("frames", generate.open_generator),
}


#: Slices of one address, one inside another.
SLICE = r"slice:(\d+)\+(\d+)!"


def data_bytes(uri: Column) -> Column:
    """The bytes of a data: address, base64 or percent-encoded; null for any other."""
    head, body = F.regexp_extract(uri, r"^data:([^,]*),", 1), F.regexp_replace(uri, r"^data:[^,]*,", "")
    plain = F.url_decode(F.replace(body, F.lit("+"), F.lit("%2B")))
    return F.when(uri.rlike(r"(?s)^data:[^,]*,"), F.when(F.endswith(head, F.lit(";base64")), F.unbase64(F.url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))))).otherwise(plain.cast("binary")))


def resolved(addresses: DataFrame, uri: str = "uri") -> DataFrame:
    """addresses with data: what each row's data:, slice: or concat: address holds, as column expressions.

    Slices may stand inside slices, and in the parts of a concat; a part of another
    scheme, or none, makes the whole null.
    """
    outer = F.col(uri)
    parts = F.when(F.startswith(outer, F.lit("concat:")), F.split(F.substring(outer, 8, F.lit(1 << 30)), r"\|")).otherwise(F.array(outer))

    def one(part: Column) -> Column:
        cuts = F.reverse(F.regexp_extract_all(F.regexp_extract(part, f"^((?:{SLICE.replace('(', '(?:')})*)", 1), F.lit(r"slice:(\d+\+\d+)!"), F.lit(1)))
        inner = data_bytes(F.regexp_replace(part, f"^(?:{SLICE.replace('(', '(?:')})*", ""))
        number = lambda cut, i: F.get(F.split(cut, r"\+"), i).cast("int")
        return F.aggregate(cuts, inner, lambda data, cut: F.substring(data, number(cut, 0) + 1, number(cut, 1)))

    return addresses.withColumn("data", F.aggregate(F.transform(parts, one), F.lit(b""), lambda a, x: F.concat(a, x)))


def scheme_of(uri: str) -> str:
    m = re.match(r"([a-z][a-z0-9+.-]*):", uri)
    return m[1] if m else "file"


def open_uri(spark: SparkSession, uri: str, shape: str | None = None) -> DataFrame:
    """The source's rows; asking for another shape than the scheme has is an error by name."""
    scheme = scheme_of(uri)
    if scheme not in READERS:
        raise Unsupported(f"{uri}: no source for scheme {scheme}")
    kind, reader = READERS[scheme]
    if shape and shape != kind:
        raise Unsupported(f"{uri}: {scheme} gives {kind}, not {shape}")
    return reader(spark, uri)


def title_paths(labels: list[str], template: str) -> dict[str, str]:
    """Output path of each title; %s takes the label, and more than one title needs it."""
    if not labels:
        raise ValueError("the source has no titles")
    if len(labels) > 1 and "%s" not in template:
        raise ValueError(f"{template}: {len(labels)} titles need %s in the output path")
    return {label: template.replace("%s", label) for label in labels}


def read_job_source(inline: str | None, path: str | None, stdin: Callable[[], str]) -> str:
    """Job text: inline first, then standard input for -, then the file."""
    if inline is not None:
        return inline
    if path == "-":
        return stdin()
    if path is None:
        raise ValueError("no job given")
    with open(path, encoding="utf-8") as f:
        return f.read()
