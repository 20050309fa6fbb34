"""Addresses, sizes and metadata as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _last_segment(uri: Column) -> Column:
    return F.split_part(F.element_at(F.split(uri, "/"), -1), F.lit("?"), F.lit(1))


def extension(uri: Column) -> Column:
    """Lower-case text after the last dot of the last segment, before any query; null without a dot."""
    found = F.lower(F.regexp_extract(_last_segment(uri), r"\.([^.]*)$", 1))
    return F.nullif(found, F.lit(""))


def stem(uri: Column) -> Column:
    """The last segment without its query and last extension; null when empty."""
    return F.nullif(F.regexp_replace(_last_segment(uri), r"\.[^.]*$", ""), F.lit(""))


def _tenths(x: Column) -> Column:
    """One decimal, exact halves to even."""
    return F.format_string("%.1f", F.bround(x, 1))


def human_bytes(n: Column) -> Column:
    """x.x MB from a mebibyte, whole KB from a kibibyte, else B."""
    mega = F.concat(_tenths(n / F.lit(1048576.0)), F.lit(" MB"))
    return F.when(n >= 1048576, mega).when(n >= 1024, F.format_string("%d KB", F.floor(n / 1024).cast("long"))).otherwise(F.format_string("%d B", n.cast("long")))


def iec_bytes(n: Column) -> Column:
    """B, KiB, MiB, GiB or TiB with one decimal."""
    out = F.format_string("%d B", n.cast("long"))
    for unit, size in (("KiB", 1 << 10), ("MiB", 1 << 20), ("GiB", 1 << 30), ("TiB", 1 << 40)):
        out = F.when(n >= size, F.concat(_tenths(n / F.lit(float(size))), F.lit(f" {unit}"))).otherwise(out)
    return out


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def normal_breaks(text: Column) -> Column:
    """Without a byte order mark, and with LF for CRLF and CR."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def engine_of(codec: Column) -> Column:
    """Hardware engine by the implementation's name; the first match wins."""
    return (
        F.when(codec.contains("nvdec") | codec.contains("nvenc"), "nvidia")
        .when(codec.startswith("vaapi") | codec.contains("_vaapi"), "vaapi")
        .when(codec.contains("vdpau"), "vdpau")
        .when(codec.contains("vulkan"), "vulkan")
    )


def page_span(uri: Column) -> Column:
    """struct(uri, first, last) of an address with a page selector behind it: [0] or [2-5]; pages count from 0, null without one."""
    inner = F.regexp_extract(uri, r"\[(\d+)(?:-(\d+))?\]$", 1)
    until = F.regexp_extract(uri, r"\[(\d+)-(\d+)\]$", 2)
    number = lambda c: F.nullif(c, F.lit("")).cast("int")
    return F.struct(F.regexp_replace(uri, r"\[\d+(-\d+)?\]$", "").alias("uri"), number(inner).alias("first"), F.coalesce(number(until), number(inner)).alias("last"))


def numbered_name(template: str, number: Column) -> Column:
    """A name with the number in the place of its %d or %03d; before the extension where it has none."""
    if "%" not in template:
        stem_, dot, tail = template.rpartition(".")
        template = f"{stem_}-%d{dot}{tail}" if dot else f"{template}-%d"
    return F.format_string(template, number)


def json_escaped(text: Column) -> Column:
    """A path as it stands between the quotes of a JSON text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def resolved_path(base: Column, relative: Column) -> Column:
    """A relative address against the folder of its base; absolute paths and addresses with a scheme stay."""
    folder = F.regexp_replace(base, r"[^/]*$", "")
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    joined = F.when(relative.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), relative).when(F.startswith(relative, F.lit("/")), F.concat(origin, relative)).otherwise(F.concat(folder, relative))
    return F.regexp_replace(F.regexp_replace(joined, r"/\./", "/"), r"/[^/]+/\.\./", "/")


#: What the keys of a player ask for.
COMMANDS = {" ": "toggle_pause", "q": "quit", "left": "seek -10", "right": "seek 10", "up": "volume 5", "down": "volume -5", "m": "mute"}


def command_of(key: Column) -> Column:
    """The command of a key in any case; null for others."""
    low = F.when(key == " ", key).otherwise(F.lower(F.trim(key)))
    return F.element_at(F.create_map(*(F.lit(x) for pair in COMMANDS.items() for x in pair)), low)


def latency_text(milliseconds: Column) -> Column:
    """none, or milliseconds with one decimal below ten and none from there on."""
    return F.when(milliseconds.isNull() | (milliseconds <= 0), "none").when(milliseconds < 10, F.concat(_tenths(milliseconds), F.lit(" ms"))).otherwise(F.format_string("%d ms", F.floor(milliseconds).cast("long")))
