"""Cleaning and splitting of subtitle and screenplay text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKERS = (".", "!", "?", "-")


def strip_space(text: Column) -> Column:
    """Without white space, in the Unicode sense, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def remove_html_tags(text: Column) -> Column:
    """Without anything from < to the next > on its line."""
    return F.regexp_replace(text, r"<[^\n]*?>", "")


def remove_override_blocks(text: Column) -> Column:
    """Without anything from { to the next } on its line."""
    return F.regexp_replace(text, r"\{[^\n]*?\}", "")


def clean_ass_text(text: Column) -> Column:
    """Line breaks and hard spaces of ASS become spaces, override blocks go, runs of white space become one space."""
    plain = remove_override_blocks(F.regexp_replace(text, r"\\[Nnh]", " "))
    return strip_space(F.regexp_replace(plain, r"(?U)\s+", " "))


def clean_srt_text(text: Column, remove_html: bool = True) -> Column:
    return remove_html_tags(text) if remove_html else text


def _any_of(markers: tuple) -> str:
    return "".join("\\" + m if not m.isalnum() else m for m in markers)


def ends_sentence(text: Column, markers: tuple = MARKERS) -> Column:
    """Whether ``text`` ends with one of the markers."""
    found = F.lit(False)
    for m in markers:
        found = found | F.endswith(text, F.lit(m))
    return found


def split_sentences(text: Column, markers: tuple = MARKERS) -> Column:
    """Sentences: cut at white space behind a marker, stripped, without empty ones."""
    parts = F.split(text, rf"(?U)(?<=[{_any_of(markers)}])\s+")
    return F.filter(F.transform(parts, strip_space), lambda s: s != "")


def clean_parenthetical(text: Column) -> Column:
    """Without one outer pair of parentheses and the white space around."""
    inner = F.regexp_replace(F.regexp_replace(strip_space(text), r"^\(", ""), r"\)$", "")
    return strip_space(inner)


def split_character(text: Column) -> Column:
    """struct(name, extensions): a character line without its parentheses and final points, and what they hold."""
    extensions = F.regexp_extract_all(text, F.lit(r"\(([^)]+)\)"), 1)
    name = F.regexp_replace(strip_space(F.regexp_replace(text, r"(?U)\s*\([^)]+\)", "")), r"\.+$", "")
    return F.struct(name.alias("name"), extensions.alias("extensions"))
