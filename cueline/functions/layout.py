"""Screenplay lines whose columns carry meaning: character lines and simultaneous dialogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions.text import rstrip_space, split_character, strip_space

#: Words of one name are at most this far apart, two names more than this, columns of dialogue more than this.
WITHIN_NAME, BETWEEN_NAMES, WITHIN_COLUMN = 3, 6, 2


def widest_gap(line: Column, least: int) -> Column:
    """struct(start, length) of the widest gap of ``least`` or more white space in a line that ends in ink; of equal ones the last. Null if there is none.

    start is how many characters stand before the gap.
    """
    gaps = F.regexp_extract_all(line, F.lit(rf"(?<=\S)\s{{{least},}}(?=\S)"), 0)
    inked = F.split(line, rf"(?<=\S)\s{{{least},}}(?=\S)")
    sizes = F.transform(gaps, F.length)
    # The gap's number, from 1: the first from behind that is the widest.
    k = (F.size(sizes) + 1 - F.array_position(F.reverse(sizes), F.array_max(sizes))).cast("int")
    upto = lambda x, n: F.aggregate(F.slice(x, F.lit(1), n), F.lit(0), lambda s, v: s + F.length(v))
    return F.when(F.size(gaps) > 0, F.struct((upto(inked, k) + upto(gaps, k - 1)).alias("start"), F.array_max(sizes).alias("length")))


def parse_character_line(line: Column) -> Column:
    """array<struct<name, extensions>>: the one or, behind a gap of more than ``BETWEEN_NAMES``, two speakers of a character line; null for null."""
    line = rstrip_space(line)
    gap = widest_gap(line, WITHIN_NAME + 1)
    left, right = F.substring(line, F.lit(1), gap["start"]), F.substring(line, gap["start"] + gap["length"] + 1, F.length(line))
    none = F.array().cast("array<struct<name:string,extensions:array<string>>>")
    two = F.array(split_character(left), split_character(right))
    return F.when(line == "", none).when(gap["length"] > BETWEEN_NAMES, two).when(line.isNotNull(), F.array(split_character(line)))


def split_simultaneous(table: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """``table`` with ``left`` and ``right``: the columns of its lines, each block of ``key`` read in ``order``.

    Columns are more than ``WITHIN_COLUMN`` apart, at the widest gap. A single column goes right if it begins where the last right column of an
    earlier line of the block did, or behind.
    """
    line = rstrip_space(F.coalesce(F.col(content), F.lit("")))
    gap = widest_gap(line, WITHIN_COLUMN + 1)
    own = table.withColumn("_line", line).withColumn("_gap", gap)
    begins = F.col("_gap.start") + F.col("_gap.length")
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_right", F.last(begins, ignorenulls=True).over(before))
    text = strip_space(F.col("_line"))
    indent = F.length("_line") - F.length(F.regexp_replace("_line", r"^\s+", ""))
    two, goes_right = F.col("_gap").isNotNull(), (text != "") & (indent >= F.col("_right"))
    left = F.when(two, strip_space(F.substring(F.col("_line"), F.lit(1), F.col("_gap.start")))).when(goes_right, "").otherwise(text)
    right = F.when(two, F.substring(F.col("_line"), begins + 1, F.length("_line"))).when(goes_right, text).otherwise("")
    return own.select(*table.columns, left.alias("left"), right.alias("right"))
