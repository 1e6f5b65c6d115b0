"""Errors that readers and operators raise on the driver; in data they become null columns or raise_error messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CuelineError(Exception):
    """Base of all errors of the library."""


class SubtitleError(CuelineError):
    """A subtitle file or stream can't be read."""


class ScreenplayError(CuelineError):
    """A labelled screenplay breaks its format."""


class VideoError(CuelineError):
    """A video's description lacks what is asked for."""


class SpriteError(CuelineError):
    """A storyboard or sprite request can't be met."""


class ShotError(CuelineError):
    """A shot request can't be met."""


class DatasetError(CuelineError):
    """A timestamped table is missing or has another form."""


def surely(df: DataFrame, error: Column) -> DataFrame:
    """``df``, failing with the message ``error`` in the first row where it isn't null, whichever columns are read, and also for a count."""
    return df.where(F.when(error.isNotNull(), F.raise_error(error).cast("boolean")).otherwise(F.lit(True)))
