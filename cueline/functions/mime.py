"""Headers and parts of MIME text, found by searches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.functions.text import strip_space


def unfolded(headers: Column) -> Column:
    """Headers, to each of which the lines that go on with white space are joined."""
    return F.regexp_replace(headers, r"\r*\n[ \t]+", "")


def header_value(headers: Column, name: str) -> Column:
    """The value of the first header of that name, in any case; null if there is none or it is empty."""
    own = F.regexp_extract(unfolded(headers), rf"(?imd)^{re.escape(name)}:([^\n]*)", 1)
    return F.nullif(strip_space(own), F.lit(""))


def content_type(headers: Column) -> Column:
    """Content-Type in lower case, without parameters; null if there is none."""
    return F.lower(strip_space(F.substring_index(header_value(headers, "Content-Type"), ";", 1)))


def boundary(text: Column) -> Column:
    """The quoted boundary parameter; null if there is none."""
    return F.nullif(strip_space(F.regexp_extract(text, r'(?i)boundary="([^"]*)"', 1)), F.lit(""))


def materialised(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: later expressions read it, whatever the optimiser merges."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parts(text: Column, mark: Column) -> Column:
    """array<array<string>> of what stands behind each delimiter line of the boundary ``mark``: headers and body, or one text without an empty line.

    Two linear searches: one for delimiter lines over the text, one for the first empty line of each part. Headers end at it.
    """
    # A line of the delimiter alone; every sign of the boundary stands for itself.
    plain = F.regexp_replace(mark, r"([^A-Za-z0-9])", r"\\$1")
    delimiter = F.concat(F.lit("(?md)^--"), plain, F.lit(r"(?:--)?[ \t\r]*$"))
    return F.transform(F.filter(F.split(text, delimiter), lambda _, i: i > 0), lambda p: F.split(F.substring(p, 2, 2_147_483_647), r"(?:^|\n)\r?\n", 2))


def part_headers(part: Column) -> Column:
    """The headers of a part; null if it has none."""
    return F.when(F.size(part) == 2, F.rtrim(F.get(part, F.lit(0)), F.lit("\r")))


def part_body(part: Column) -> Column:
    """The body of a part, without the line end before the next delimiter; null if it has no headers."""
    body = F.get(part, F.lit(1))
    cut = F.when(F.endswith(body, F.lit("\n")), F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    return F.when(F.size(part) == 2, F.rtrim(cut, F.lit("\r")))


def sheet_filename(idx: Column, kind: Column) -> Column:
    """sheet_<idx>.<subtype> of a content type."""
    return F.concat(F.lit("sheet_"), idx.cast("string"), F.lit("."), F.substring_index(kind, "/", -1))
