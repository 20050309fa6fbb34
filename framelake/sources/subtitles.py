"""Text subtitles to cue rows and back, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_breaks

_TIME = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})"


def _micros(text: Column) -> Column:
    g = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, _TIME, i), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return ((g(1) * 60 + g(2)) * 60 + g(3)) * 1_000_000 + g(4) * 1000


def _blocks(files: DataFrame) -> DataFrame:
    """(uri, n, block): blank-line separated blocks of (uri, text)."""
    parts = F.split(F.regexp_replace(normal_breaks(F.col("text")), r"\A\s+|\s+\z", ""), r"\n[ \t]*\n+")
    return files.select("uri", F.posexplode(parts).alias("n", "block"))


def parse_arrow_cues(files: DataFrame) -> DataFrame:
    """SubRip and WebVTT: (uri, cue_no, start_us, end_us, text); blocks without a time line are left out."""
    line = F.regexp_extract("block", rf"(?m)^({_TIME}) *--> *({_TIME})", 0)
    rows = _blocks(files).withColumn("line", line).where("line <> ''")
    start, end = F.split_part("line", F.lit("-->"), F.lit(1)), F.split_part("line", F.lit("-->"), F.lit(2))
    body = F.regexp_replace("block", rf"(?s)\A.*?{_TIME} *--> *{_TIME}[^\n]*\n?", "")
    number = F.row_number().over(Window.partitionBy("uri").orderBy("n"))
    return rows.select("uri", number.cast("long").alias("cue_no"), _micros(start).alias("start_us"), _micros(end).alias("end_us"), body.alias("text"))


def parse_lines(files: DataFrame, pattern: str, start: Column, end: Column) -> DataFrame:
    """One cue a line: MicroDVD, MPL2 and the like; start and end are columns over g1, g2."""
    lines = files.select("uri", F.posexplode(F.split(normal_breaks(F.col("text")), "\n")).alias("n", "line")).where(F.col("line").rlike(pattern))
    g = lambda i: F.regexp_extract("line", pattern, i)
    rows = lines.select("uri", "n", g(1).cast("long").alias("g1"), g(2).cast("long").alias("g2"), F.replace(g(3), F.lit("|"), F.lit("\n")).alias("text"))
    number = F.row_number().over(Window.partitionBy("uri").orderBy("n"))
    return rows.select("uri", number.cast("long").alias("cue_no"), start.cast("long").alias("start_us"), end.cast("long").alias("end_us"), "text")


def parse_microdvd(files: DataFrame, fps: float = 25.0) -> DataFrame:
    return parse_lines(files, r"^\{(\d+)\}\{(\d+)\}(.*)$", F.round(F.col("g1") * (1e6 / fps)), F.round(F.col("g2") * (1e6 / fps)))


def parse_mpl2(files: DataFrame) -> DataFrame:
    return parse_lines(files, r"^\[(\d+)\]\[(\d+)\](.*)$", F.col("g1") * 100_000, F.col("g2") * 100_000)


def parse_vplayer(files: DataFrame) -> DataFrame:
    """HH:MM:SS:text lines; a cue ends where the next begins, the last after four seconds."""
    pattern = r"^(\d+):(\d{2}):(\d{2})[:= ](.*)$"
    lines = files.select("uri", F.posexplode(F.split(normal_breaks(F.col("text")), "\n")).alias("n", "line")).where(F.col("line").rlike(pattern))
    g = lambda i: F.regexp_extract("line", pattern, i)
    start = ((g(1).cast("long") * 60 + g(2).cast("long")) * 60 + g(3).cast("long")) * 1_000_000
    w = Window.partitionBy("uri").orderBy("n")
    rows = lines.select("uri", "n", start.alias("start_us"), F.replace(g(4), F.lit("|"), F.lit("\n")).alias("text"))
    return rows.select("uri", F.row_number().over(w).cast("long").alias("cue_no"), "start_us", F.coalesce(F.lead("start_us").over(w), F.col("start_us") + 4_000_000).alias("end_us"), "text")


def parse_mpsub(files: DataFrame) -> DataFrame:
    """Blocks of "wait duration" seconds and text, each relative to the end of the one before."""
    head = r"^([0-9.]+) +([0-9.]+)\n"
    rows = _blocks(files).where(F.col("block").rlike(head))
    second = lambda i: F.round(F.regexp_extract("block", head, i).cast("double") * 1e6).cast("long")
    w = Window.partitionBy("uri").orderBy("n")
    rows = rows.select("uri", "n", second(1).alias("wait"), second(2).alias("length"), F.regexp_replace("block", head, "").alias("text"))
    until = F.sum(F.col("wait") + F.col("length")).over(w)
    return rows.select("uri", F.row_number().over(w).cast("long").alias("cue_no"), (until - F.col("length")).alias("start_us"), until.alias("end_us"), "text")


def _clock(us: Column, mark: str) -> Column:
    ms = F.floor(us / 1000)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def _numbered(rows: DataFrame, start: Column, end: Column, text: Column) -> DataFrame:
    """Cue rows of (uri, n, ...) in the order of n."""
    number = F.row_number().over(Window.partitionBy("uri").orderBy("n"))
    return rows.select("uri", number.cast("long").alias("cue_no"), start.cast("long").alias("start_us"), end.cast("long").alias("end_us"), text.alias("text"))


# Advanced text: sections of comma-separated lines, whose columns a Format line names

_ASS_FIELDS = ("Layer", "Start", "End", "Style", "Name", "MarginL", "MarginR", "MarginV", "Effect", "Text")
_ASS_HEAD = """[Script Info]
ScriptType: v4.00+

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, Bold, Italic, Underline, Alignment
Style: Default,Sans,24,&H00FFFFFF,0,0,0,2

[Events]
Format: """ + ", ".join(_ASS_FIELDS)


def _hundredths(text: Column) -> Column:
    """H:MM:SS.cc in microseconds."""
    parts = F.transform(F.split(F.trim(text), "[:.]"), lambda p: p.try_cast("long"))
    return F.when(F.size(parts) == 4, F.aggregate(F.zip_with(parts, F.array(*map(F.lit, (3_600_000_000, 60_000_000, 1_000_000, 10_000))), lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x))


def plain_markup(text: Column) -> Column:
    """Override codes as markup: italics, bold and underlining as tags, line breaks as such, all others left out."""
    for pattern, new in ((r"\{\\(?<t>[ibu])1\}", "<${t}>"), (r"\{\\(?<t>[ibu])0?\}", "</${t}>"), (r"\{[^}]*+\}", ""), (r"\\N", "\n"), (r"\\[nh]", " ")):
        text = F.regexp_replace(text, pattern, new)
    return text


def override_codes(text: Column) -> Column:
    """The way back; other tags are left out."""
    for pattern, new in (("<(?<t>[ibu])>", "{\\\\${t}1}"), ("</(?<t>[ibu])>", "{\\\\${t}0}"), ("</?[A-Za-z][^>]*+>", ""), ("\n", "\\\\N")):
        text = F.regexp_replace(text, pattern, new)
    return text


def parse_ass(files: DataFrame) -> DataFrame:
    """Dialogue lines by the columns that their file names; the text is the last one and may hold commas."""
    whole = normal_breaks(F.col("text"))
    named = F.split(F.trim(F.regexp_extract(whole, r"(?s)\[Events\][^\[]*?\nFormat: *([^\n]*)", 1)), r" *, *")
    fields = F.when(F.size(named) > 1, named).otherwise(F.array(*map(F.lit, _ASS_FIELDS)))
    once = lambda value: F.explode(F.array(value))  # noqa: E731: a row's value, computed once however often it is used after
    place = lambda name: (F.array_position("h.f", name) - 1).cast("int")
    heads = files.select("uri", once(F.struct(fields.alias("f"), F.split(whole, "\n").alias("lines"))).alias("h"))
    heads = heads.select("uri", once(F.struct(F.size("h.f").alias("size"), place("Start").alias("start"), place("End").alias("end"))).alias("f"), F.col("h.lines").alias("lines"))
    lines = heads.select("uri", "f", F.posexplode("lines").alias("n", "line")).where(F.startswith("line", F.lit("Dialogue:")))
    parts = lines.select("uri", "n", "f", once(F.split(F.regexp_replace("line", "^Dialogue: *", ""), ",", F.col("f.size"))).alias("p"))
    cell = lambda name: F.get("p", F.col(f"f.{name}"))
    rows = parts.select("uri", "n", F.filter(F.array(F.struct(_hundredths(cell("start")).alias("s"), _hundredths(cell("end")).alias("e"))), lambda t: t["s"].isNotNull() & t["e"].isNotNull()).alias("times"), F.get("p", F.col("f.size") - 1).alias("t"))
    rows = rows.select("uri", "n", F.explode("times").alias("time"), "t")  # lines of bad times have none
    return _numbered(rows, F.col("time.s"), F.col("time.e"), plain_markup(F.col("t")))


def _clock_hundredths(us: Column, hours: str) -> Column:
    c = F.floor(us / 10_000)
    return F.format_string(f"{hours}:%02d:%02d.%02d", F.floor(c / 360_000), F.floor(c / 6000) % 60, F.floor(c / 100) % 60, c % 100)


# Frames and marks


def parse_pjs(files: DataFrame, fps: float = 25.0) -> DataFrame:
    """first frame, last frame, "text" on a line."""
    return parse_lines(files, r'^ *(\d+), *(\d+), *"(.*)" *$', F.round(F.col("g1") * (1e6 / fps)), F.round(F.col("g2") * (1e6 / fps)))


def parse_aqtitle(files: DataFrame, fps: float = 25.0) -> DataFrame:
    """Texts after frame marks; the next mark ends a cue, four seconds the last one."""
    parts = F.split(F.concat(F.lit("\n"), normal_breaks(F.col("text"))), r"\n-->> *")
    rows = files.select("uri", F.posexplode(parts).alias("n", "part")).where(F.col("part").rlike(r"^\d+"))
    frame = F.regexp_extract("part", r"^(\d+)", 1).cast("long")
    rows = rows.select("uri", "n", frame.alias("g1"), F.regexp_replace("part", r"^\d+[^\n]*\n?|\s+\z", "").alias("t"))
    rows = rows.withColumn("g2", F.lead("g1").over(Window.partitionBy("uri").orderBy("n"))).where("t <> ''")
    micros = lambda c: F.round(F.col(c) * (1e6 / fps)).cast("long")
    return _numbered(rows, micros("g1"), F.coalesce(micros("g2"), micros("g1") + 4_000_000), F.col("t"))


_SUBVIEWER = r"\A *(\d+:\d{2}:\d{2}\.\d{2}), *(\d+:\d{2}:\d{2}\.\d{2}) *\n"


def parse_subviewer(files: DataFrame) -> DataFrame:
    """Blocks of two times and a text, in which [br] breaks lines."""
    rows = _blocks(files).where(F.col("block").rlike(_SUBVIEWER))
    time = lambda i: _hundredths(F.regexp_extract("block", _SUBVIEWER, i))
    return _numbered(rows, time(1), time(2), F.replace(F.regexp_replace("block", _SUBVIEWER, ""), F.lit("[br]"), F.lit("\n")))


# Timed text: paragraphs with begin and end

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _offset(text: Column) -> Column:
    """A clock time or an offset (12.5s, 1200ms) in microseconds."""
    parts = F.transform(F.split(F.regexp_replace(text, "m?s$", ""), ":"), lambda p: p.try_cast("double"))
    unit = F.when(F.endswith(text, F.lit("ms")), 1e3).when(F.endswith(text, F.lit("s")), 1e6)
    seconds = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.round(F.when(F.size(parts) == 3, seconds * 1e6).when(F.size(parts) == 1, seconds * unit)).cast("long")


def parse_ttml(files: DataFrame) -> DataFrame:
    """Paragraphs with both times; breaks as line breaks, other elements without their tags."""
    found = F.regexp_extract_all(normal_breaks(F.col("text")), F.lit(r"<p\b[^>]*+>(?:[^<]|<(?!/?p\b))*+</p>"), F.lit(0))
    rows = files.select("uri", F.posexplode(found).alias("n", "p"))
    time = lambda name: _offset(F.regexp_extract(F.regexp_extract("p", "^<p([^>]*+)>", 1), f"\\b{name}=[\"']([^\"']*)[\"']", 1))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("p", "^<p[^>]*+>|</p>$", ""), r"<br\s*+/?>", "\n"), "<[^>]*+>", "")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    times = F.filter(F.array(F.struct(time("begin").alias("s"), time("end").alias("e"))), lambda t: t["s"].isNotNull() & t["e"].isNotNull())
    rows = rows.select("uri", "n", F.explode(times).alias("time"), text.alias("t"))  # paragraphs without both times have none
    return _numbered(rows, F.col("time.s"), F.col("time.e"), F.col("t"))


def _escaped(text: Column) -> Column:
    for entity, char in reversed(_ENTITIES):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return F.replace(text, F.lit("\n"), F.lit("<br/>"))


PARSERS = {"subrip": parse_arrow_cues, "webvtt": parse_arrow_cues, "microdvd": parse_microdvd, "mpl2": parse_mpl2, "vplayer": parse_vplayer, "mpsub": parse_mpsub, "ass": parse_ass, "pjs": parse_pjs, "aqtitle": parse_aqtitle, "subviewer": parse_subviewer, "ttml": parse_ttml}


def _block(kind: str, fps: float) -> tuple[Column, str, str, str]:
    """(one cue as text, what stands before, between and after cues)."""
    start, end, text = F.col("start_us"), F.col("end_us"), F.col("text")
    lined = F.replace(text, F.lit("\n"), F.lit("|"))
    frame = lambda us: F.round(us * (fps / 1e6)).cast("long").cast("string")
    if kind == "ass":
        times = (_clock_hundredths(us, "%d") for us in (start, end))
        return F.concat(F.lit("Dialogue: 0,"), *(part for t in times for part in (t, F.lit(","))), F.lit("Default,,0,0,0,,"), override_codes(text)), _ASS_HEAD + "\n", "\n", "\n"
    if kind == "pjs":
        return F.concat(frame(start), F.lit(","), frame(end), F.lit(',"'), lined, F.lit('"')), "", "\n", "\n"
    if kind == "microdvd":
        return F.concat(F.lit("{"), frame(start), F.lit("}{"), frame(end), F.lit("}"), lined), "", "\n", "\n"
    if kind == "mpl2":
        tenth = lambda us: F.round(us / 100_000).cast("long").cast("string")
        return F.concat(F.lit("["), tenth(start), F.lit("]["), tenth(end), F.lit("]"), lined), "", "\n", "\n"
    if kind == "aqtitle":
        return F.concat(F.lit("-->> "), frame(start), F.lit("\n"), text, F.lit("\n\n-->> "), frame(end)), "", "\n\n", "\n\n"
    if kind == "subviewer":
        return F.concat(_clock_hundredths(start, "%02d"), F.lit(","), _clock_hundredths(end, "%02d"), F.lit("\n"), F.replace(text, F.lit("\n"), F.lit("[br]"))), "[INFORMATION]\n[END INFORMATION]\n\n", "\n\n", "\n"
    if kind == "ttml":
        line = F.concat(F.lit('<p begin="'), _clock(start, "."), F.lit('" end="'), _clock(end, "."), F.lit('">'), _escaped(text), F.lit("</p>"))
        return line, '<tt xmlns="http://www.w3.org/ns/ttml"><body><div>\n', "\n", "\n</div></body></tt>\n"
    if kind not in ("subrip", "webvtt"):
        raise ValueError(f"no writer for {kind}")
    times = F.concat(_clock(start, "," if kind == "subrip" else "."), F.lit(" --> "), _clock(end, "," if kind == "subrip" else "."))
    number = F.concat(F.col("cue_no").cast("string"), F.lit("\n")) if kind == "subrip" else F.lit("")
    return F.concat(number, times, F.lit("\n"), text), "WEBVTT\n\n" if kind == "webvtt" else "", "\n\n", "\n"


def write_cues(cues: DataFrame, kind: str, fps: float = 25.0) -> DataFrame:
    """(uri, text) of one file per uri; fps counts for formats that name frames."""
    cue, head, between, tail = _block(kind, fps)
    blocks = cues.select("uri", F.struct("cue_no", cue.alias("b")).alias("c"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["b"]), between)
    return blocks.groupBy("uri").agg(F.concat(F.lit(head), joined, F.lit(tail)).alias("text"))


def converted(files: DataFrame, source: str, target: str) -> DataFrame:
    """(uri, text) files of one format in another, through cues."""
    return write_cues(PARSERS[source](files), target)
