"""Timecodes and intervals; media time is seconds as doubles, exact to the microsecond."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: H:M:S with an optional fraction behind a comma or point, M:S with one, and S with one behind a point.
CODE = (
    r"^(?:(?:[01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d(?:[,.]\d{1,6})?"
    r"|[0-5]?\d:[0-5]?\d[,.]\d{1,6}"
    r"|[0-5]?\d\.\d{1,6})$"
)


def timecode_micros(code: Column) -> Column:
    """Microseconds of a timecode; null if it has none of the known layouts."""
    parts = F.split(code, "[,.]")
    whole = F.aggregate(F.split(parts[0], ":"), F.lit(0).cast("long"), lambda total, x: total * 60 + x.try_cast("long"))
    fraction = F.rpad(F.coalesce(F.get(parts, F.lit(1)), F.lit("0")), 6, "0").try_cast("long")
    return F.when(code.rlike(CODE), whole * 1_000_000 + fraction)


def timecode_seconds(code: Column) -> Column:
    """Seconds of a timecode; null if it has none of the known layouts."""
    return timecode_micros(code) / F.lit(1e6)


def to_seconds(value: Column, kind: str = "double") -> Column:
    """Seconds of a number, or of a day-time interval if ``kind`` is "interval"."""
    if kind != "interval":
        return value.cast("double")
    return (
        F.extract(F.lit("DAY"), value) * 86400 + F.extract(F.lit("HOUR"), value) * 3600 + F.extract(F.lit("MINUTE"), value) * 60
    ).cast("double") + F.extract(F.lit("SECOND"), value).cast("double")


def duration(start: Column, end: Column) -> Column:
    return end - start


def midpoint(start: Column, end: Column) -> Column:
    return start + (end - start) / 2


def first_half(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), midpoint(start, end).alias("end"))


def second_half(start: Column, end: Column) -> Column:
    return F.struct(midpoint(start, end).alias("start"), end.alias("end"))


def srt_code(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm of seconds."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string(
        f"%02d:%02d:%02d{mark}%03d", (ms / 3600000).cast("long"), (ms / 60000).cast("long") % 60, (ms / 1000).cast("long") % 60, ms % 1000
    )
