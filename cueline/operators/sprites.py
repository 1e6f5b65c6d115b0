"""Sampling plans of sprites and shots; pixels come from an injected decoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.errors import ShotError, SpriteError, surely
from cueline.functions.grid import cell_box, grid_cells, last_grid, resolve_shape, sprites_in
from cueline.schema import SPRITE


def plan_select(videos: DataFrame, fps: float) -> DataFrame:
    """``videos`` (fps, n_frames) exploded to the frames that one decoding pass keeps: pos, frame_idx, timestamp, ts_exact.

    Every round(source fps / fps)-th frame is kept and stamped k / fps; ts_exact is where it really is.
    """
    step = F.greatest(F.bround(F.col("fps") / fps), F.lit(1)).cast("long")
    kept = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_frames") - 1) / step))).alias("pos")
    out = videos.where("n_frames > 0").select("*", step.alias("step"), kept)
    return out.withColumn("frame_idx", F.col("pos") * F.col("step")).withColumn("timestamp", F.col("pos") / fps).withColumn("ts_exact", F.col("frame_idx") / F.col("fps")).drop("step")


def plan_seek(videos: DataFrame, fps: float) -> DataFrame:
    """``videos`` (duration) exploded to the times that single seeks look up: pos, timestamp."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("duration") * fps).cast("long"))).alias("pos")
    return videos.select("*", at).withColumn("timestamp", F.col("pos") / fps)


def scaled(videos: DataFrame, height: int | None = None, width: int | None = None, ratio: float | None = None) -> DataFrame:
    """``videos`` with the height and width that their frames are scaled to; a ratio excludes the other two."""
    given = [F.lit(x).cast(kind) for x, kind in ((height, "int"), (width, "int"), (ratio, "double"))]
    shape = resolve_shape(F.col("height"), F.col("width"), *given)
    return videos.withColumn("_shape", shape).withColumn("height", F.col("_shape.height")).withColumn("width", F.col("_shape.width")).drop("_shape")


def plan_frames(videos: DataFrame, times: DataFrame, on: str = "filepath") -> DataFrame:
    """The single frames that are wanted of ``videos``: ``times`` (``on``, timestamp, more) with pos, in order of time, and the video's columns."""
    at = Window.partitionBy(on).orderBy("timestamp")
    return times.withColumn("pos", F.row_number().over(at).cast("long") - 1).join(videos, on)


def _gridded(sheets: DataFrame, rows: int, cols: int, on: str) -> DataFrame:
    """``sheets`` with fps, n (sprites), _grid (rows, cols) and before (sprites on earlier sheets)."""
    w = Window.partitionBy(on)
    first, last = F.min("idx").over(w), F.max("idx").over(w)
    rate = F.max(F.when(F.col("idx") == F.col("_first"), rows * cols / (F.col("end") - F.col("start")))).over(w)
    own = sheets.withColumn("_first", first).withColumn("_last", last).withColumn("fps", rate)
    own = own.withColumn("before", (F.row_number().over(w.orderBy("idx")) - 1) * (rows * cols))
    ending = (F.col("idx") == F.col("_last")) & (F.col("idx") != F.col("_first"))
    n = F.when(ending, sprites_in(F.col("end") - F.col("start"), F.col("fps"))).otherwise(rows * cols)
    own = own.withColumn("n", n).withColumn("_grid", F.when(ending, last_grid(F.col("n"), F.lit(cols))).otherwise(F.struct(F.lit(rows).alias("rows"), F.lit(cols).alias("cols"))))
    return own.where("n > 0").drop("_first", "_last")


def sheet_plan(sheets: DataFrame, rows: int, cols: int, height: str = "height", width: str = "width", on: str = "filepath") -> DataFrame:
    """Sprites of storyboard ``sheets`` (``on``, idx, start, end, height, width): cell, timestamp and pixel box.

    The first sheet's cells over its duration are the rate. The last sheet has as many sprites as fit its duration, in a grid of its own.
    """
    own = _gridded(sheets, rows, cols, on)
    own = own.select("*", F.explode(F.slice(grid_cells(F.col("_grid.rows"), F.col("_grid.cols")), F.lit(1), F.col("n"))).alias("cell"))
    box = cell_box(F.col("cell"), F.col(height), F.col(width), F.col("_grid.rows"), F.col("_grid.cols"))
    return own.withColumn("timestamp", F.col("start") + F.col("cell") / F.col("fps")).select("*", box.alias("box")).drop("_grid", "n", "before")


def crop_cell(image: np.ndarray, cell: int, rows: int, cols: int) -> np.ndarray:
    """One cell of a grid over an image (height, width, channels); pixels beyond whole cells are left out."""
    h, w = image.shape[0] // rows, image.shape[1] // cols
    r, c = divmod(cell, cols)
    return image[r * h : (r + 1) * h, c * w : (c + 1) * w]


def sheet_frames(sheets: DataFrame, rows: int, cols: int, fetch: Callable[[str], np.ndarray], on: str = "filepath") -> DataFrame:
    """``on`` and the sprites of storyboard ``sheets`` (``on``, idx, start, end, location), cut from the images that ``fetch(location)`` returns.

    A task holds one sheet at a time. A sheet without location, or one that can't be fetched, is a SpriteError that names it.
    """
    own = _gridded(sheets, rows, cols, on)
    own = own.select(F.col(on).alias("file"), "idx", "start", "location", "fps", "n", "before", F.col("_grid.rows").alias("rows"), F.col("_grid.cols").alias("cols"))
    names = [c.split()[0] for c in SPRITE.split(", ")]

    def run(batches):
        for batch in batches:
            for sheet in batch.itertuples():
                if not sheet.location:
                    raise SpriteError(f"{sheet.file}: sheet {sheet.idx} has no location")
                try:
                    image = np.asarray(fetch(sheet.location), np.uint8)
                except Exception as e:
                    raise SpriteError(f"{sheet.file}: sheet {sheet.idx} can't be fetched: {e}") from e
                cut = []
                for k in range(sheet.n):
                    cell = crop_cell(image, k, sheet.rows, sheet.cols)
                    cut.append((sheet.file, sheet.before + k, sheet.start + k / sheet.fps, *cell.shape, cell.tobytes()))
                yield pd.DataFrame(cut, columns=[on, *names])

    return own.mapInPandas(run, f"`{on}` {sheets.schema[on].dataType.simpleString()}, {SPRITE}")


def whole_frames(frames: DataFrame) -> DataFrame:
    """``frames``, with an error for one that hasn't as many bytes as its shape needs."""
    needed = F.col("height") * F.col("width") * F.col("channels")
    short = F.when(F.length("frame").isNull() | (F.length("frame") != needed), F.concat(F.lit("a frame lacks pixels at timestamp "), F.col("timestamp").cast("string")))
    return surely(frames, short)


def decode_frames(plan: DataFrame, decode: Callable[[pd.DataFrame], Iterator[tuple]], columns: str = SPRITE) -> DataFrame:
    """Frames of a plan: ``decode`` gets its rows in batches and yields rows of ``columns``."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            yield pd.DataFrame(list(decode(batch)), columns=names)

    return plan.mapInPandas(run, columns)


def shots(frames: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Frames where a shot begins: their scene score is above ``threshold``, strictly between 0 and 1."""
    if not 0 < threshold < 1:
        raise ShotError("threshold must be between 0 and 1, both excluded")
    return frames.where(F.col(score) > threshold)
