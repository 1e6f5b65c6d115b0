"""SRT and ASS readers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueline.errors import SubtitleError, surely
from cueline.functions.text import clean_ass_text, clean_srt_text
from cueline.functions.timecode import timecode_seconds
from cueline.sources.encoding import decode

#: Names of a cue's coordinates, in the order in which a time line may have them.
CORNERS = ("X1", "X2", "Y1", "Y2")
_CUE = "idx long, filepath string, line_idx long, start_code string, end_code string, content string, x1 long, y1 long, x2 long, y2 long, error string"


def time_line(line: str) -> tuple | None:
    """(start, end, x1, x2, y1, y2) of a cue's time line, null for coordinates it lacks; all are null without X1. None if it is no such line."""
    start, arrow, rest = line.partition("-->")
    end, *marks = rest.split() or [""]
    if not arrow or len(start.split()) != 1 or not end:
        return None
    corners = [x.partition(":") for x in marks]
    places = [CORNERS.index(c) if c in CORNERS else -1 for c, _, _ in corners]
    if -1 in places or places != sorted(set(places)) or not all(v.isdecimal() for _, _, v in corners):
        return None
    found = {c: int(v) for c, _, v in corners} if "X1:" in rest else {}
    return (start.strip(), end, *(found.get(c) for c in CORNERS))


def srt_cues(path: str, text: str):
    """Rows of the cues of an SRT text: index line, time line, content up to an empty line.

    A cue without content isn't ended by an empty line: what follows is its content. A bad line ends the reading
    with a row whose error names it.
    """
    idx = at = times = None
    content: list[str] = []
    row = lambda error=None: (idx, path, at, *(times or (None,) * 6)[:2], " ".join(content), *[times[i] for i in (2, 4, 3, 5)], error) if times else (None, path, at, None, None, None, None, None, None, None, error)
    for n, line in enumerate(re.split(r"\r\n|\r|\n", text), 1):
        line = line.strip()
        if not line and not (times and content):
            continue
        if not line:
            yield row()
            idx = times = None
            content = []
        elif idx is None:
            if not re.fullmatch(r"[+-]?\d+", line):
                yield (None, path, n, *(None,) * 7, f"{path}:{n}: no index: {line!r}")
                return
            idx, at = int(line), n
        elif times is None:
            times = time_line(line)
            if not times:
                yield (None, path, n, *(None,) * 7, f"{path}:{n}: no timestamps: {line!r}")
                return
        else:
            content.append(line)
    if times and content:
        yield row()


def _typed(cues: DataFrame, clean) -> DataFrame:
    """Cues with seconds and clean content; a bad timecode is an error like a bad line."""
    start, end = timecode_seconds(F.col("start_code")), timecode_seconds(F.col("end_code"))
    bad = F.col("error").isNull() & (start.isNull() | end.isNull())
    error = F.when(bad, F.concat_ws(":", "filepath", F.col("line_idx").cast("string"), F.lit(" bad timestamps"))).otherwise(F.col("error"))
    return cues.select(
        "idx", "filepath", "line_idx", start.alias("timestamp_start"), end.alias("timestamp_end"), clean(F.col("content")).alias("content"),
        F.lit(None).cast("array<double>").alias("embedding"), "x1", "y1", "x2", "y2", error.alias("error"),
    )


def _strict(cues: DataFrame, mode: str) -> DataFrame:
    if mode == "PERMISSIVE":
        return cues
    if mode != "FAILFAST":
        raise SubtitleError("mode must be FAILFAST or PERMISSIVE")
    return surely(cues, F.col("error")).drop("error")


def parse_srt(files: DataFrame, path: str = "path", content: str = "content", remove_html: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """Cues of SRT ``files`` (path, content as text or bytes). FAILFAST raises on the first bad line; PERMISSIVE has an error column."""

    def run(batches):
        for batch in batches:
            rows = [r for p, c in zip(batch[path], batch[content]) for r in srt_cues(p, decode(c))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _CUE.split(", ")])

    found = files.select(path, content).mapInPandas(run, _CUE)
    return _strict(_typed(found, lambda c: clean_srt_text(c, remove_html)), mode)


def parse_ass(files: DataFrame, path: str = "path", content: str = "content", mode: str = "FAILFAST") -> DataFrame:
    """Cues of ASS ``files`` (path, content as text): Dialogue lines of the Events section, whose fields the Format line orders.

    Built-in functions only: lines are exploded, sections and formats are the last seen in a window over each file.
    """
    lines = files.select(F.col(path).alias("filepath"), F.posexplode(F.split(F.col(content), r"\r\n|\r|\n")).alias("n", "line"))
    lines = lines.withColumn("line", F.trim("line"))
    w = Window.partitionBy("filepath").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.nullif(F.regexp_extract("line", r"^\[(.*)\]$", 1), F.lit(""))
    fields = F.transform(F.split(F.regexp_extract("line", r"(?i)^format:(.*)$", 1), ","), lambda x: F.lower(F.trim(x)))
    lines = lines.withColumn("section", F.last(F.lower(header), ignorenulls=True).over(w)).where("section = 'events'")
    lines = lines.withColumn("fields", F.last(F.when(F.col("line").rlike("(?i)^format:"), fields), ignorenulls=True).over(w))
    rows = lines.where(F.col("line").rlike("^Dialogue:"))
    values = F.split(F.ltrim(F.substring("line", 10, 2_147_483_647)), ",", F.size("fields"))
    rows = rows.withColumn("values", values)
    where = F.concat_ws(":", "filepath", (F.col("n") + 1).cast("string"))
    needed = F.array(F.lit("start"), F.lit("end"), F.lit("text"))
    error = (
        F.when(F.col("fields").isNull(), F.concat(where, F.lit(": Dialogue before Format")))
        .when(F.size(F.array_except(needed, "fields")) > 0, F.concat(where, F.lit(": Format lacks start, end or text")))
        .when(F.size("values") != F.size("fields"), F.concat(where, F.lit(": fewer fields than Format")))
    )
    rows = rows.withColumn("error", error)
    pick = lambda name: F.when(F.col("error").isNull(), F.get("values", F.array_position("fields", name).cast("int") - 1))
    order = Window.partitionBy("filepath").orderBy("n")
    none = lambda name: F.lit(None).cast("long").alias(name)
    cues = rows.select(
        F.row_number().over(order).cast("long").alias("idx"), "filepath", (F.col("n") + 1).cast("long").alias("line_idx"), F.trim(pick("start")).alias("start_code"),
        F.trim(pick("end")).alias("end_code"), pick("text").alias("content"), none("x1"), none("y1"), none("x2"), none("y2"), "error",
    )
    return _strict(_typed(cues, clean_ass_text), mode)


def read_srt(spark: SparkSession, paths, remove_html: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """Cues of SRT files, one task a group of files; the encoding is detected."""
    return parse_srt(spark.read.format("binaryFile").load(paths), remove_html=remove_html, mode=mode)


def read_ass(spark: SparkSession, paths, mode: str = "FAILFAST") -> DataFrame:
    """Cues of ASS files."""
    files = spark.read.format("binaryFile").load(paths)

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(decode)

    return parse_ass(files.select("path", text("content").alias("content")), mode=mode)


def parse_stream(codec: str, files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Cues of demuxed subtitle streams (path, content) by the name of their codec."""
    if codec == "subrip":
        return parse_srt(files, mode=mode)
    if codec == "ass":
        return parse_ass(files, mode=mode)
    raise SubtitleError(f"unsupported subtitle codec {codec!r}")


def read_video_subtitles(videos: DataFrame, demux, codec: str, mode: str = "FAILFAST") -> DataFrame:
    """Cues of the subtitle streams of ``videos`` (path, stream): ``demux(path, stream)`` returns the stream's text."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [demux(p, s) for p, s in zip(batch["path"], batch["stream"])]})

    return parse_stream(codec, videos.select("path", "stream").mapInPandas(run, "path string, content string"), mode)
