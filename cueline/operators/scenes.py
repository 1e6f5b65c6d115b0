"""Scenes of a script placed in the windows of a film, in an order that may jump.

Two levels: what it costs to place a scene in a window is found within each pair of them, and a dynamic program over
scenes chooses the windows. Its state is the last window used, so a scene may lie before its forerunner, within a limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.operators.anchors import rounded


def scene_costs(cells: DataFrame, on: list[str], scene: str = "scene", window: str = "window", line: str = "i", value: str = "value") -> DataFrame:
    """``on``, scene, window, cost of similarity ``cells``: how far a scene's lines are, on average, from their best match in the window.

    Two aggregations that combine before they shuffle; costs of another kind, such as subsequence warping distances, do as well.
    """
    best = cells.groupBy(*on, F.col(scene).alias("scene"), F.col(window).alias("window"), line).agg(F.max(value).alias("_best"))
    return best.groupBy(*on, "scene", "window").agg(F.avg(1 - F.col("_best")).alias("cost"))


class _Placement:
    """The dynamic program over the scenes of a film, which come one after the other; windows are as many as scenes have named so far."""

    def __init__(self, jump: int, penalty: float, skip: float):
        self.jump, self.penalty, self.skip = jump, penalty, skip
        self.best = np.zeros(1)  # by the last window used, 0: none yet
        self.came: list[np.ndarray] = []  # how far a scene jumps to each window; -1: it is left out, as no scene takes its forerunner's window
        self.costs: list[np.ndarray] = []

    def add(self, costs: np.ndarray) -> None:
        """The next scene, with its costs of windows from 0 on."""
        m = max(len(costs), len(self.best) - 1)
        costs, best = (np.append(x, np.full(n - len(x), np.inf)) for x, n in ((costs, m), (self.best, m + 1)))
        jump = min(self.jump, m)
        found, jumps = np.full(m + 1, np.inf), np.full(m + 1, -1, np.int8 if jump < 127 else np.int32)
        for d in range(jump, -jump - 1, -1):
            if d == -1:
                continue
            at = np.arange(max(1, 1 + d), min(m, m + 1 + d) + 1)  # windows, from 1, whose forerunner at - 1 - d is one of 0 to m
            value = best[at - 1 - d] + self.penalty * abs(d) + costs[at - 1]
            better = value < found[at]
            found[at[better]], jumps[at[better]] = value[better], d
        left = best + self.skip < found
        found[left], jumps[left] = best[left] + self.skip, -1
        self.best = found
        self.came.append(jumps)
        small = costs.astype(np.float32)
        self.costs.append(small if (small == costs).all() else costs)

    def placed(self) -> tuple[float, list[int | None], list[float | None]]:
        """(total, windows, costs)."""
        at = int(self.best.argmin())
        total, out, costs = float(self.best[at]), [], []
        for jumps, own in zip(reversed(self.came), reversed(self.costs)):
            d = int(jumps[at])
            out.append(None if d == -1 else at - 1)
            costs.append(None if d == -1 else float(own[at - 1]))
            at = at if d == -1 else at - 1 - d
        return total, out[::-1], costs[::-1]


def place(costs: np.ndarray, jump: int, penalty: float, skip: float) -> tuple[float, list[int | None]]:
    """(total, window of each scene or None) of the cheapest placement of scenes (rows of ``costs``) in windows (columns).

    A scene costs its cell and ``penalty`` for each window by which it misses the one behind the last used, by ``jump`` at most, or ``skip`` if it is left
    out. Two scenes in a row never share a window. Of equal placements the one is taken that places the later scene, and the earlier scenes in lower windows.
    """
    film = _Placement(jump, penalty, skip)
    for row in costs:
        film.add(row)
    return film.placed()[:2]


def align_scenes(costs: DataFrame, on: list[str], jump: int = 3, penalty: float = 0.0, skip: float = 1.0) -> DataFrame:
    """``on``, scene, window (null: left out), cost, total: the cheapest placement of the scenes of each film ``on``.

    ``costs``: ``on``, scene, window, cost; scenes and windows are numbered from 0 in their order. A pair without a row, or with a null or no finite cost,
    is not allowed; of repeated pairs the least cost counts; rows with a null scene or window are dropped. No rows: no films. A film is one task's work:
    scenes times windows times jumps steps, and up to nine bytes for each scene and window; films run in parallel.
    """
    cost = F.col("cost").cast("double")
    known = costs.select(*on, F.col("scene").cast("long").alias("scene"), F.col("window").cast("long").alias("window"), F.when(F.abs(cost) < float("inf"), cost).alias("cost"))
    known = known.where("scene >= 0 and window >= 0").fillna(float("inf"), ["cost"])
    own = known.groupBy(*on, "scene").agg(F.collect_list(F.struct("window", "cost")).alias("_own"))

    kinds = {f.name: f.dataType for f in known.schema}
    fields = [T.StructField(k, kinds[k]) for k in on] + [T.StructField("scene", T.LongType()), T.StructField("windows", T.BinaryType()), T.StructField("costs", T.BinaryType())]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [[x.values.field(n).to_numpy(zero_copy_only=False).tobytes() for x in batch.column("_own")] for n in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*on, "scene")), *(pa.array(x, pa.binary()) for x in both)], [*on, "scene", "windows", "costs"])

    return align_packed(own.mapInArrow(pack, T.StructType(fields)), on, jump, penalty, skip)


def align_packed(costs: DataFrame, on: list[str], jump: int = 3, penalty: float = 0.0, skip: float = 1.0, digits: int | None = None, unit: float = 1.0) -> DataFrame:
    """``align_scenes`` of rows ``on``, scene, windows, costs, as ``anchors.best_matches`` makes them; costs are taken ``unit`` times, rounded to ``digits``.

    A film's rows pass through its task scene by scene, and no row of a scene and a window is made.
    """
    kinds = {f.name: f.dataType for f in costs.schema}
    fields = [T.StructField(k, kinds[k]) for k in on]
    fields += [T.StructField(k, t) for k, t in (("scene", T.LongType()), ("window", T.LongType()), ("cost", T.DoubleType()), ("total", T.DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = film = types = None
        scene, own = 0, np.zeros(0)

        def placed() -> pa.RecordBatch:
            film.add(own)
            total, windows, found = film.placed()
            columns = [pa.array([v] * len(windows), t) for v, t in zip(key, types)]
            columns += [pa.array(range(len(windows)), pa.int64()), pa.array(windows, pa.int64()), pa.array(found, pa.float64()), pa.array([total] * len(windows))]
            return pa.RecordBatch.from_arrays(columns, [*on, "scene", "window", "cost", "total"])

        for batch in batches:
            types = [batch.schema.field(c).type for c in on]
            for k in range(batch.num_rows):
                *place, at, windows, values = (batch.column(c)[k].as_py() for c in (*on, "scene", "windows", "costs"))
                if place != key:
                    if film:
                        yield placed()
                    key, film, scene, own = place, _Placement(jump, penalty, skip), 0, np.zeros(0)
                while scene < at:
                    film.add(own)
                    scene, own = scene + 1, np.zeros(0)
                j, cost = np.frombuffer(windows, np.int64), np.frombuffer(values) * unit
                cost = cost if digits is None else rounded(cost, digits)
                own = np.append(own, np.full(max(int(j.max(initial=-1)) + 1 - len(own), 0), np.inf))
                np.minimum.at(own, j, np.where(np.abs(cost) < np.inf, cost, np.inf))
        if film:
            yield placed()

    rows = costs.select(*on, "scene", "windows", "costs")
    sent = rows.repartition(*on) if on else rows.coalesce(1)
    return sent.sortWithinPartitions(*on, "scene").mapInArrow(run, T.StructType(fields))
