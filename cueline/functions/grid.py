"""Image shapes, grids of sprites and sampling times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rescale_shape(height: Column, width: Column, ratio: Column) -> Column:
    return F.struct((height * ratio).cast("int").alias("height"), (width * ratio).cast("int").alias("width"))


def resolve_shape(height: Column, width: Column, to_height: Column, to_width: Column, ratio: Column) -> Column:
    """struct(height, width) to scale to: by ``ratio``, or to one or both sides, keeping the aspect; else as it is."""
    ratio_given = ratio.isNotNull() & (ratio != 0)
    h_given, w_given = to_height.isNotNull() & (to_height != 0), to_width.isNotNull() & (to_width != 0)

    def shape(h: Column, w: Column) -> Column:
        return F.struct(h.cast("int").alias("height"), w.cast("int").alias("width"))

    both = F.raise_error(F.lit("pass either a ratio or a shape, not both")).cast("struct<height:int,width:int>")
    return (
        F.when(ratio_given & (h_given | w_given), both)
        .when(ratio_given, rescale_shape(height, width, ratio))
        .when(h_given & ~w_given, shape(to_height, width * to_height / height))
        .when(w_given & ~h_given, shape(height * to_width / width, to_width))
        .when(h_given & w_given, shape(to_height, to_width))
        .otherwise(shape(height, width))
    )


def cell_box(idx: Column, height: Column, width: Column, rows: Column, cols: Column) -> Column:
    """struct(row, col, x1, y1, x2, y2) of a cell of a grid over an image, in pixels."""
    h, w = F.floor(height / rows).cast("int"), F.floor(width / cols).cast("int")
    r, c = F.floor(idx / cols).cast("int"), F.pmod(idx, cols).cast("int")
    return F.struct(
        r.alias("row"), c.alias("col"), (c * w).alias("x1"), (r * h).alias("y1"), ((c + 1) * w).alias("x2"), ((r + 1) * h).alias("y2")
    )


def grid_cells(rows: Column, cols: Column) -> Column:
    """Array of all cell numbers, row by row."""
    return F.sequence(F.lit(0), (rows * cols - 1).cast("int"))


def sprites_in(duration: Column, fps: Column) -> Column:
    """Whole sprites in a duration; a product just under a whole number by rounding counts as it."""
    return F.floor(duration * fps + 1e-6).cast("int")


def last_grid(sprites: Column, cols: Column) -> Column:
    """struct(rows, cols) of a last sheet: one row if it isn't filled, else as many as are needed."""
    one = sprites <= cols
    return F.struct(
        F.when(one, 1).otherwise(F.ceil(sprites / cols).cast("int")).alias("rows"), F.when(one, sprites).otherwise(cols).cast("int").alias("cols")
    )
