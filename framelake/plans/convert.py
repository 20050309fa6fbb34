"""A picture conversion command as a job: input, operations in their order, output.

    photo -resize 320x200 -blur 0x1.5 -dither ordered -colors 16 out.bmp

Every operation is a node of a job graph, so it runs as any job does; neighbouring
operations on single pixels run in one pass without a shuffle.  An operation that is not known
is refused by name, and so is a value that it cannot take.
"""

from __future__ import annotations

import re
import shlex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .job import PICTURE, Job, JobError, filter_named

#: Codecs by the output's ending.
ENDINGS = {"bmp": "bmp", "qoi": "qoi", "ff": "farbfeld", "ppm": "pnm", "pnm": "pnm"}
DITHERS = {"none": "none", "ordered": "ordered", "floydsteinberg": "diffusion"}


@filter_named("strip")
def _strip(frames: DataFrame, params: dict) -> DataFrame:
    """A picture's pixels and nothing else."""
    kept = (PICTURE, "x", "y", "value", "pixel_format", "stored")
    return frames.select(*[c for c in frames.columns if c in kept])


@filter_named("pixels")
def _pixels(frames: DataFrame, params: dict) -> DataFrame:
    """Values of 0 to 1 as stored gray in three equal parts."""
    level = F.round(F.least(F.greatest("value", F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return frames.withColumns({"pixel_format": F.lit("rgb24"), "stored": F.array(level, level, level)}).drop("value")


def _numbers(op: str, value: str, pattern: str) -> list[float]:
    found = re.fullmatch(pattern, value)
    if found is None:
        raise JobError(f"{op}: cannot take {value}")
    return [float(g) for g in found.groups() if g is not None]


def parse_convert(command: str | list[str], size: tuple[int, int]) -> Job:
    """The job of a command over pictures of ``size`` (width, height); the output @null encodes nothing."""
    words = shlex.split(command) if isinstance(command, str) else list(command)
    if len(words) < 2 or words[0].startswith("-") or words[-1].startswith("-"):
        raise JobError("a conversion needs an input and an output")
    tree: dict = {"from": words[0]}
    output, rest = words[-1], words[1:-1]
    width, height = size
    dither, codec, quality = "none", None, None

    def add(name: str, **params: object) -> None:
        nonlocal tree
        tree = {"filter": name, "params": params, "input": tree}

    while rest:
        op = rest.pop(0)
        if op == "-strip":
            add("strip")
            continue
        if op not in ("-resize", "-blur", "-edge", "-colors", "-dither", "-format", "-quality"):
            raise JobError(f"{op}: not yet implemented")
        if not rest:
            raise JobError(f"{op}: needs a value")
        value = rest.pop(0)
        if op == "-resize":
            wide, high = (int(n) for n in _numbers(op, value, r"([1-9]\d*)x([1-9]\d*)"))
            add("resize", w=width, h=height, new_w=wide, new_h=high, kind="bilinear")
            width, height = wide, high
        elif op == "-blur":
            sigma = [*_numbers(op, value, r"(\d+(?:\.\d+)?)(?:x(\d+(?:\.\d+)?))?"), 1.0][1]
            if sigma == 0:
                raise JobError(f"{op}: cannot take {value}")
            add("blur", sigma=sigma)
        elif op == "-edge":
            _numbers(op, value, r"(\d+(?:\.\d+)?)")
            add("edge")
        elif op == "-colors":
            add("quantize", colours=int(_numbers(op, value, r"(\d+)")[0]), dither=dither)
        elif op == "-dither":
            if value.lower() not in DITHERS:
                raise JobError(f"{op}: cannot take {value}")
            dither = DITHERS[value.lower()]
        elif op == "-format":
            codec = ENDINGS.get(value.lower(), value.lower())
        else:
            quality = int(_numbers(op, value, r"(\d{1,2}|100)")[0])
    if not output.startswith("@"):
        codec = codec or ENDINGS.get(output.rsplit(".", 1)[-1].lower())
        if codec is None:
            raise JobError(f"{output}: no codec for this ending")
    if codec is not None:
        add("pixels")
        tree = tree | {"codec": codec, "codec_params": {} if quality is None else {"quality": quality}}
    return Job({output: {"video": [tree]}})
