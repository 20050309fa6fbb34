"""Content-based format detection and the lookup of formats by extension.

Every format scores the first bytes of a payload; the extension only breaks ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBE_BYTES = 256 * 1024
#: Fixed values: (format, ((offset, magic), ...), score) of public formats.
MAGIC = (
    ("wav", ((8, b"WAVE"),), 100),
    ("avi", ((8, b"AVI "),), 100),
    ("webp", ((8, b"WEBP"),), 100),
    ("flac", ((0, b"fLaC"),), 100),
    ("ogg", ((0, b"OggS"),), 100),
    ("matroska", ((0, b"\x1aE\xdf\xa3"),), 100),
    ("mp4", ((4, b"ftyp"),), 100),
    ("flv", ((0, b"FLV\x01"),), 100),
    ("ivf", ((0, b"DKIF"),), 100),
    ("png", ((0, b"\x89PNG\r\n\x1a\n"),), 100),
    ("gif", ((0, b"GIF8"),), 100),
    ("jpeg", ((0, b"\xff\xd8\xff"),), 90),
    ("tiff", ((0, b"II*\x00"),), 90),
    ("bmp", ((0, b"BM"), (6, b"\0\0\0\0")), 60),
    ("qoi", ((0, b"qoif"),), 100),
    ("farbfeld", ((0, b"farbfeld"),), 100),
    ("ape", ((0, b"MAC "),), 100),
    ("mpegts", ((0, b"G"), (188, b"G"), (376, b"G")), 60),
    ("webvtt", ((0, b"WEBVTT"),), 100),
    ("stl", ((0, b"solid "),), 50),
    ("pdf", ((0, b"%PDF-"),), 100),
    ("html", ((0, b"<!DOCTYPE html>"),), 100),
    ("pnm", ((0, b"P6"),), 30),
    ("pnm", ((0, b"P5"),), 30),
)
#: File extensions of the formats that can be written.
EXTENSIONS = {"wav": "wav", "ivf": "ivf", "ppm": "pnm", "pgm": "pnm", "pnm": "pnm", "bmp": "bmp", "ff": "farbfeld", "qoi": "qoi", "srt": "subrip", "vtt": "webvtt", "sub": "microdvd", "mpl": "mpl2", "stl": "stl", "obj": "obj", "slin": "slin"}


class FormatNotFound(ValueError):
    """No extension, or none that a format is registered for."""


def probe(data: Column, extension: Column) -> Column:
    """struct(format, score): the best score; an equal score goes to the format that the extension names; text otherwise."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    hint = F.try_element_at(known, extension)

    def one(name: str, parts: tuple, score: int) -> Column:
        fits = reduce(lambda a, b: a & b, [F.substring(data, at + 1, len(magic)) == F.lit(magic) for at, magic in parts])
        return F.when(fits, F.struct(F.lit(score).alias("score"), (F.coalesce(hint, F.lit("")) == name).cast("int").alias("hinted"), F.lit(name).alias("format")))

    found = [one(*row) for row in MAGIC]
    other = F.struct(F.lit(1).alias("score"), F.lit(0).alias("hinted"), F.lit("text").alias("format"))
    best = F.array_max(F.filter(F.array(*found, other), lambda x: x.isNotNull()))
    return F.struct(best["format"].alias("format"), best["score"].alias("score"))


def probe_bytes(data: bytes, extension: str | None = None) -> str:
    """The same decision for one payload on the driver."""
    scored = [(score, EXTENSIONS.get(extension or "") == name, name) for name, parts, score in MAGIC if all(data[at : at + len(magic)] == magic for at, magic in parts)]
    return max(scored, default=(1, False, "text"))[2]


def format_of(path: Column) -> Column:
    """format_for_path() of a column, null where that is an error."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    last = F.element_at(F.split(F.get(F.split(F.element_at(F.split(path, "/"), -1), r"\?"), 0), r"\."), -1)
    return F.when(F.get(F.split(F.element_at(F.split(path, "/"), -1), r"\?"), 0).contains("."), F.try_element_at(known, F.lower(last)))


def format_for_path(path: str) -> str:
    """The writer of a path's extension."""
    last = path.split("/")[-1].split("?")[0]
    if "." not in last:
        raise FormatNotFound(f"{path}: no extension")
    ext = last.rsplit(".", 1)[1].lower()
    if ext not in EXTENSIONS:
        raise FormatNotFound(f"{path}: no format is registered for .{ext}")
    return EXTENSIONS[ext]
