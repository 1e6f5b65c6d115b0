"""Cues to utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions.text import MARKERS, ends_sentence
from cueline.functions.timecode import midpoint


def to_utterances(cues: DataFrame, key: str = "filepath", markers: tuple = MARKERS) -> DataFrame:
    """Utterances of ``cues`` (``key``, idx, line_idx, timestamp_start, timestamp_end, content, embedding), by file.

    A cue that ends with a marker closes an utterance; others are joined with what follows. A cue "- A - B" has two speakers:
    A is an utterance on the first half of the time, and B begins another on the second. A cue that begins with a dash
    but is no such pair is an utterance of its own. The embedding stays only where an utterance is one whole cue.
    Expressed as pieces, flags where an utterance starts, and their running sum in each file.
    """
    start, end, content = F.col("timestamp_start"), F.col("timestamp_end"), F.col("content")
    mid = midpoint(start, end)
    kind = cues.schema["embedding"].dataType
    dash = F.startswith(content, F.lit("- "))
    halves = F.split(F.substring(content, 3, 2_147_483_647), " - ")

    def piece(text, a, b, solo, whole):
        vector = F.col("embedding") if whole else F.lit(None).cast(kind)
        return F.struct(
            text.alias("content"), a.alias("start"), b.alias("end"), F.lit(solo).alias("solo"), F.lit(whole).alias("whole"), vector.alias("embedding")
        )

    two = F.array(piece(halves[0], start, mid, True, False), piece(halves[1], mid, end, False, False))
    pieces = (
        F.when(dash & (F.size(halves) == 2), two)
        .when(dash, F.array(piece(content, start, end, True, True)))
        .otherwise(F.array(piece(content, start, end, False, True)))
    )
    cut = cues.select(key, "idx", "line_idx", F.posexplode(pieces).alias("part", "piece")).select(key, "idx", "line_idx", "part", "piece.*")
    # What begins with a dash also ends the utterance before it.
    w = Window.partitionBy(key).orderBy("idx", "part")
    closes = F.col("solo") | ends_sentence(F.col("content"), markers)
    cut = cut.withColumn("closes", closes).withColumn("before", F.lag("closes").over(w))
    cut = cut.withColumn("seg", F.sum(F.when(F.coalesce("before", F.lit(True)) | F.col("solo"), 1).otherwise(0)).over(w))
    own = F.array_sort(F.collect_list(F.struct("idx", "part", "content", "line_idx", "start", "end", "whole", "embedding")))
    grouped = cut.groupBy(key, "seg").agg(own.alias("own"))
    first, last = F.element_at("own", 1), F.element_at("own", -1)
    return grouped.select(
        F.col("seg").alias("idx"),
        key,
        F.transform("own", lambda x: x["line_idx"]).alias("line_idxs"),
        first["start"].alias("timestamp_start"),
        last["end"].alias("timestamp_end"),
        F.array_join(F.transform("own", lambda x: x["content"]), " ").alias("content"),
        F.when((F.size("own") == 1) & first["whole"], first["embedding"]).alias("embedding"),
    )
