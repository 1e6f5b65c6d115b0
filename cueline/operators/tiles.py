"""Dynamic time warping of long sequences over many tasks.

The matrix of a pair of sequences is cut into square tiles. Tiles of one anti-diagonal don't depend on each other: they are one round of tasks,
for all pairs at once, and only the last row and column of a tile are written. The path goes back through the rounds from its end; a tile on it is computed
again from the borders before it, and hands the cell at which the path leaves it to the tile that has that cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.operators.dtw import METHODS, cost_matrix
from cueline.operators.timeline import with_position
from cueline.shared import Rounds

#: Positions of a tile on each axis.
TILE = 2048
#: Tasks of a round at most; further tiles of it are dealt to the same tasks.
TASKS = 10_000
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_DONE = "pair long, p long, q long, bottom binary, right binary, least double, at long"
_WALKED = "pair long, p long, q long, i long, j long, open boolean"


def tile_sums(cost: np.ndarray, top: np.ndarray, left: np.ndarray, free: bool = False) -> np.ndarray:
    """Least cost of a path to each cell of a tile, with the row ``top`` and the column ``left`` before it, which share their first entry.

    ``free``: a path may start in any cell of the tile's first row.
    """
    n, m = cost.shape
    out = np.full((n + 1, m + 1), np.inf)
    out[0], out[1:, 0] = top, left[1:]
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        before = np.minimum(np.minimum(out[i, j], out[i, j + 1]), out[i + 1, j])
        out[i + 1, j + 1] = cost[i, j] + (np.where(i == 0, 0, before) if free else before)
    return out


def walk_out(sums: np.ndarray, i: int, j: int, free: bool, start: bool) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """(cells of the path back from cell (i, j) within a tile, the first cell outside it, or None where the path begins).

    Cells count from 0 in the tile, so one outside it has -1. Of equal steps diagonal, then up, then left. ``free``: paths begin in the tile's first row;
    ``start``: they begin in its first cell.
    """
    path = []
    while i >= 0 and j >= 0:
        path.append((i, j))
        if i == 0 and (free or (start and j == 0)):
            return path, None
        # Entry (a, b) of the tile is entry (a + 1, b + 1) of its sums.
        _, i, j = min((sums[a + 1, b + 1], a, b) for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
    return path, (i, j)


def _border(blob: bytes | None, n: int, corner: float) -> np.ndarray:
    """A border of a tile: what the tile before it left, or one that only its corner can be entered by."""
    if blob is not None:
        return np.frombuffer(blob)
    out = np.full(n + 1, np.inf)
    out[0] = corner
    return out


@dataclass(frozen=True)
class _Cut:
    """How matrices are cut and walked: what tasks need to know besides a tile's row."""

    metric: str
    method: str
    end: int | None
    band: int | None
    tile: int

    def sums(self, row) -> np.ndarray:
        a, b = (np.frombuffer(x).reshape(n, -1) for x, n in ((row.data_p, row.rows_p), (row.data_q, row.rows_q)))
        cost = cost_matrix(a, b, self.metric)
        if self.band is not None:
            i, j = np.arange(len(a)) + row.p * self.tile, np.arange(len(b)) + row.q * self.tile
            diagonal = i * max(row.m - 1, 1) / max(row.n - 1, 1)
            cost = np.where(np.abs(diagonal[:, None] - j) <= self.band, cost, np.inf)
        top, left = row.top, row.left
        corner = 0.0 if row.p == row.q == 0 else np.frombuffer(top)[0] if top is not None else np.frombuffer(left)[0] if left is not None else np.inf
        return tile_sums(cost, _border(top, len(b), corner), _border(left, len(a), corner), self.method == "subsequence" and row.p == 0)

    def borders(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The last row and column of each tile and, if it has an end of the pair's paths, its least cost and place."""
        for batch in batches:
            for row in batch.itertuples(index=False):
                sums, first, least, at = self.sums(row), row.q * self.tile, None, None
                if row.p == (row.n - 1) // self.tile:
                    want = row.m - 1 if self.method == "classic" else self.end
                    if want is None:
                        at = first + int(sums[-1, 1:].argmin())
                    elif first <= want < first + row.rows_q:
                        at = want
                    least = None if at is None else float(sums[-1, 1 + at - first])
                found = (row.pair, row.p, row.q, sums[-1].tobytes(), np.ascontiguousarray(sums[:, -1]).tobytes(), least, at)
                yield pd.DataFrame([found], columns=_names(_DONE)).astype({"least": "Float64", "at": "Int64"})

    def walks(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells of each tile's part of a path, and the open cell where it goes on."""
        for batch in batches:
            for row in batch.itertuples(index=False):
                first, other = row.p * self.tile, row.q * self.tile
                free = self.method == "subsequence" and row.p == 0
                path, out = walk_out(self.sums(row), row.i - first, row.j - other, free, row.p == row.q == 0)
                rows = [(row.pair, row.p, row.q, i + first, j + other, False) for i, j in path]
                if out:
                    i, j = out[0] + first, out[1] + other
                    rows.append((row.pair, i // self.tile, j // self.tile, i, j, True))
                yield pd.DataFrame(rows, columns=_names(_WALKED))


def _names(kind: str) -> list[str]:
    return [x.split()[0] for x in kind.split(", ")]


def _same(left: str, right: str, on: list[str]) -> Column:
    out = F.lit(True)
    for k in on:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def _blocks(rounds: Rounds, side: DataFrame, pairs: DataFrame, on: list[str], embedding: str, name: str, tile: int) -> DataFrame:
    """pair, ``name``, rows_``name``, data_``name``: the vectors of each block of positions."""
    kind = f"pair long, {name} long, rows_{name} int, data_{name} binary"

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.stack(pdf.sort_values("pos")["vector"].to_numpy()).astype(float)
        return pd.DataFrame([(*key, len(data), data.tobytes())], columns=_names(kind))

    own = side.alias("s").join(pairs.alias("t"), _same("s", "t", on))
    own = own.select("t.pair", F.floor(F.col("s.pos") / tile).alias(name), "s.pos", F.col(f"s.{embedding}").alias("vector"))
    return rounds.save(own.groupBy("pair", name).applyInPandas(pack, kind), "blocks")


def _places(pairs: DataFrame, tile: int, band: int | None) -> DataFrame:
    """pair, n, m, p, q: all tiles, of which a band keeps those that it meets, or that a corner is handed on by (one cell off)."""
    rows, columns = (F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / tile)) for n in "nm")
    out = pairs.select("pair", "n", "m", F.explode(rows).alias("p"), columns.alias("_q")).select("pair", "n", "m", "p", F.explode("_q").alias("q"))
    if band is None:
        return out
    slope = F.greatest(F.col("m") - 1, F.lit(1)) / F.greatest(F.col("n") - 1, F.lit(1))
    return out.where((F.col("q") * tile - band - 1 <= (F.col("p") + 1) * tile * slope) & ((F.col("q") + 1) * tile + band >= F.col("p") * tile * slope))


def dtw_tiles(
    query: DataFrame, reference: DataFrame, on: list[str], order: str, metric: str = "cosine", method: str = "classic",
    end: int | None = None, band: int | None = None, embedding: str = "embedding", tile: int = TILE, parts: int | None = None,
) -> DataFrame:
    """``on``, i, j, distance: the cells of the warping path that ``dtw`` finds, one row each, for sequences of any length.

    A path's cells are in order by i and j, which count from 0; distance is the path's cost. ``parts`` numbers the positions of long sequences in ranges
    (see ``with_position``). A task holds one tile: two blocks of ``tile`` vectors and ``tile`` x ``tile`` cells. Rounds are one for each anti-diagonal
    of tiles and one for each that a path goes back through; written borders take two numbers for ``tile`` cells. Rows without a vector are left out; a pair
    of which one table has no vectors, a pair without a path in its ``band``, and an ``end`` past the reference give no rows; a null in ``on`` is a value as any other.
    Of rows at one ``order`` either may come first. Vectors must be finite and of one length.
    """
    if method not in METHODS:
        raise NotImplementedError(f"method must be one of {METHODS}")
    spark, cut = query.sparkSession, _Cut(metric, method, end, band, tile)
    # A row may hold whole blocks: workers get few bytes of them at a time, unless the session says otherwise.
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, "4m")
    rounds = Rounds(spark, "tiles")
    sides = [with_position(x.where(F.col(embedding).isNotNull()).select(*on, order, embedding), on, [order], parts) for x in (query, reference)]
    a, b = (x.groupBy(*on).agg(F.count("*").alias("n")) for x in sides)
    both = a.alias("a").join(b.alias("b"), _same("a", "b", on)).select(*[F.col(f"a.{k}").alias(k) for k in on], "a.n", F.col("b.n").alias("m"))
    pairs = rounds.save(both.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    blocks = [_blocks(rounds, x, pairs, on, embedding, name, tile) for x, name in zip(sides, "pq")]
    places = rounds.save(_places(pairs, tile, band), "places")

    def tasks(own: DataFrame, before: DataFrame | None, n: int) -> DataFrame:
        """The tiles ``own`` with their vectors and borders, in ``n`` tasks or fewer."""
        out = own.join(blocks[0], ["pair", "p"]).join(blocks[1], ["pair", "q"])
        if before is None:
            out = out.select("*", *[F.lit(None).cast("binary").alias(c) for c in ("top", "left")])
        else:
            tops = before.select("pair", (F.col("p") + 1).alias("p"), "q", F.col("bottom").alias("top"))
            lefts = before.select("pair", "p", (F.col("q") + 1).alias("q"), F.col("right").alias("left"))
            out = out.join(tops, ["pair", "p", "q"], "left").join(lefts, ["pair", "p", "q"], "left")
        # Tiles are small in bytes and long in time, so they are dealt out by number.
        return out.repartition(min(n, TASKS), "pair", "p", "q")

    # One count for each anti-diagonal: rounds are run one after the other.
    counts = dict(places.groupBy((F.col("p") + F.col("q")).alias("d")).count().collect())
    done: dict[int, DataFrame] = {}
    for d in sorted(counts):
        sent = tasks(places.where(F.col("p") + F.col("q") == d), done.get(d - 1), counts[d])
        done[d] = rounds.save(sent.mapInPandas(cut.borders, _DONE), "borders")
    if not done:
        return pairs.select(*on, F.col("n").alias("i"), F.col("m").alias("j"), F.lit(0.0).alias("distance")).limit(0)
    ends = rounds.several(list(done.values())).groupBy("pair").agg(F.min(F.when(F.col("at").isNotNull(), F.struct("least", "at"))).alias("e"))
    ends = ends.where("e.least < double('infinity')").join(pairs, "pair").select("pair", (F.col("n") - 1).alias("i"), F.col("e.at").alias("j"), F.col("e.least").alias("distance"))
    ends = rounds.save(ends, "ends")
    begun = ends.select("pair", F.floor(F.col("i") / tile).alias("p"), F.floor(F.col("j") / tile).alias("q"), "i", "j", F.lit(True).alias("open"))
    walked: list[DataFrame] = []
    for d in sorted(counts, reverse=True):
        # A diagonal step skips a round, so a path's open cell is in one of the two rounds before, or at its end.
        cells = begun.unionByName(rounds.several(walked[-2:])) if walked else begun
        own = cells.where(F.col("open") & (F.col("p") + F.col("q") == d)).join(places, ["pair", "p", "q"])
        walked.append(rounds.save(tasks(own, done.get(d - 1), counts[d]).mapInPandas(cut.walks, _WALKED), "walked"))
    path = rounds.several(walked).where("not open").select("pair", "i", "j")
    return path.join(ends.select("pair", "distance"), "pair").join(pairs, "pair").select(*on, "i", "j", "distance")
