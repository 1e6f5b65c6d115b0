"""Explicit schemas of the records that readers return and sinks write."""

from __future__ import annotations

SUBTITLE = (
    "idx long, filepath string, line_idx long, timestamp_start double, timestamp_end double, content string, "
    "embedding array<double>, x1 long, y1 long, x2 long, y2 long"
)
UTTERANCE = (
    "idx long, filepath string, line_idxs array<long>, timestamp_start double, timestamp_end double, content string, "
    "embedding array<double>"
)
SINGLETON = (
    "id int, scene_id int, scene_heading string, character string, content string, source_line_start_idx int, "
    "source_line_stop_idx int, embedding array<double>"
)
SCREENPLAY_LINE = "filepath string, line_idx int, labels array<string>, content string"
SPRITE = "pos long, timestamp double, height int, width int, channels int, frame binary"
SHOT = "pos long, timestamp double, score double, height int, width int, channels int, frame binary"
SHEET = "idx int, start double, end double, cid string, rows int, cols int, location string, type string"
STREAM = "index int, codec_name string, codec_long_name string, start_time double, duration double, language string, title string"

#: Names of the line labels of an annotated screenplay.
LABELS = {
    "A": "act", "C": "character", "D": "deleted scene", "E": "extension", "G": "page gap", "I": "ignored", "M": "metadata",
    "N": "narrative", "O": "blank", "P": "parenthetical", "S": "scene heading", "T": "transition", "U": "utterance", "Y": "chyron",
}
