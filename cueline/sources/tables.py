"""Parsing and segmentation as table functions of SQL.

``register(spark)`` gives SQL two functions. ``parse_srt(path, text)`` has the cues of a file: ``SELECT cues.* FROM files, LATERAL parse_srt(path, text) AS cues``.
``to_utterances(TABLE(cues))`` has the utterances of a table of cues; it asks Spark for the cues of a file together and in order by itself.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from cueline.errors import SubtitleError
from cueline.functions.text import MARKERS
from cueline.functions.timecode import CODE
from cueline.sources.encoding import decode
from cueline.sources.subtitles import srt_cues

CUES = "idx long, line_idx long, timestamp_start double, timestamp_end double, content string, x1 long, y1 long, x2 long, y2 long, error string"
UTTERANCES = "idx long, filepath string, line_idxs array<long>, timestamp_start double, timestamp_end double, content string"
_TYPES = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "array<long>": T.ArrayType(T.LongType())}
_NEEDED = {"idx", "filepath", "line_idx", "timestamp_start", "timestamp_end", "content"}


def _schema(fields: str) -> T.StructType:
    """Of "name type, ...": functions are analysed in a worker, where Spark's own parser isn't at hand."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in fields.split(", "))])


def seconds(code: str | None) -> float | None:
    """Seconds of a timecode; None if it has none of the known layouts."""
    if code is None or not re.fullmatch(CODE, code):
        return None
    whole, _, fraction = code.replace(",", ".").partition(".")
    total = 0
    for part in whole.split(":"):
        total = total * 60 + int(part)
    return (total * 1_000_000 + int(fraction.ljust(6, "0"))) / 1e6


class Segmenter:
    """Utterances of one file's cues, which are pushed in order; the rules are those of ``operators.utterance.to_utterances``."""

    def __init__(self, markers: tuple = MARKERS):
        self.markers, self.open, self.n = markers, [], 0

    def _close(self) -> list[tuple]:
        if not self.open:
            return []
        lines, starts, ends, texts = zip(*self.open)
        self.open, self.n = [], self.n + 1
        return [(self.n, list(lines), starts[0], ends[-1], " ".join(t for t in texts if t is not None))]

    def push(self, line_idx: int | None, start: float | None, end: float | None, content: str | None) -> list[tuple]:
        """(idx, line_idxs, start, end, content) of the utterances that this cue ends. A null text ends its utterance and adds nothing."""
        dash = content is not None and content.startswith("- ")
        halves = content[2:].split(" - ") if dash else []
        if len(halves) == 2:
            middle = None if start is None or end is None else start + (end - start) / 2
            pieces = [(halves[0], start, middle, True), (halves[1], middle, end, False)]
        else:
            pieces = [(content, start, end, dash)]
        out = []
        for text, a, b, solo in pieces:
            if solo:
                out += self._close()
            self.open.append((line_idx, a, b, text))
            if solo or text is None or text.endswith(self.markers):
                out += self._close()
        return out

    def flush(self) -> list[tuple]:
        """The utterance that is still open."""
        return self._close()


class ParseSrt:
    """Cues of one SRT text. A bad line or timecode is a row with an error, and a bad line ends its file; a null text has no cues."""

    @staticmethod
    def analyze(path: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        for what, given in (("path", path), ("text", text)):
            if given.isTable or not isinstance(given.dataType, (T.StringType, T.BinaryType, T.NullType)):
                raise SubtitleError(f"parse_srt: {what} must be a string or binary")
        return AnalyzeResult(_schema(CUES))

    def eval(self, path, text):
        if text is None:
            return
        for idx, _, at, start, end, content, x1, y1, x2, y2, error in srt_cues(path or "", decode(text)):
            a, b = seconds(start), seconds(end)
            if not error and (a is None or b is None):
                error = f"{path or ''}:{at}: bad timestamps"
            yield idx, at, a, b, content, x1, y1, x2, y2, error


class ToUtterances:
    """Utterances of a table of cues (filepath, idx, line_idx, timestamp_start, timestamp_end, content; others are not read), by file and in the order of idx."""

    @staticmethod
    def analyze(cues: AnalyzeArgument) -> AnalyzeResult:
        if not cues.isTable:
            raise SubtitleError("to_utterances needs TABLE(cues)")
        missing = sorted(_NEEDED - set(cues.dataType.names))
        if missing:
            raise SubtitleError(f"to_utterances: cues lack {', '.join(missing)}")
        return AnalyzeResult(_schema(UTTERANCES), partitionBy=[PartitioningColumn("filepath")], orderBy=[OrderingColumn("idx")])

    def __init__(self):
        self.own, self.path = Segmenter(), None

    def _rows(self, found: list[tuple]):
        for idx, *rest in found:
            yield (idx, self.path, *rest)

    def eval(self, cue):
        self.path = cue["filepath"]
        yield from self._rows(self.own.push(cue["line_idx"], cue["timestamp_start"], cue["timestamp_end"], cue["content"]))

    def terminate(self):
        yield from self._rows(self.own.flush())


def register(spark: SparkSession) -> None:
    """Make ``parse_srt`` and ``to_utterances`` known to the session's SQL."""
    spark.udtf.register("parse_srt", udtf(ParseSrt))
    spark.udtf.register("to_utterances", udtf(ToUtterances))
