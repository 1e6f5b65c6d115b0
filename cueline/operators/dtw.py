"""Dynamic time warping of embedded sequences, classic and subsequence."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("classic", "subsequence")
SIDE = "_cueline_side"
RESULT = "distance double, path array<struct<i:int,j:int>>"
ARTIFACTS = ", cost array<array<double>>, accumulated array<array<double>>"
#: Cells of the matrix that are held at a time; larger matrices are worked through in bands of rows.
CELLS = 4_000_000


def cost_matrix(query: np.ndarray, reference: np.ndarray, metric: str = "cosine") -> np.ndarray:
    """Distances of all pairs of rows."""
    if query.ndim != 2 or reference.ndim != 2:
        raise ValueError("sequences must be two-dimensional")
    if metric in ("cosine", "dot"):
        if metric == "cosine":
            query, reference = (x / np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None] for x in (query, reference))
        return 1 - query @ reference.T
    if metric == "euclidean":
        return np.sqrt(np.stack([((row - reference) ** 2).sum(1) for row in query]))
    if metric == "manhattan":
        return np.stack([np.abs(row - reference).sum(1) for row in query])
    raise ValueError(f"unknown metric {metric!r}")


def accumulate(cost: np.ndarray, method: str = "classic", band: int | None = None, above: np.ndarray | None = None, first: int = 0, rows: int | None = None) -> np.ndarray:
    """Least cost of a path to each cell; a subsequence path may start in any column. ``band`` limits how far paths leave the diagonal.

    Cells of an anti-diagonal only need the two before it, so each is one array step. A part of the matrix that begins with row ``first`` of ``rows``
    goes on from the accumulated row ``above`` it.
    """
    if method not in METHODS:
        raise NotImplementedError(f"method must be one of {METHODS}")
    n, m = cost.shape
    rows = rows or n
    free = above is None and method == "subsequence"  # each cell of the first row is a start
    out = np.full((n + 1, m + 1), np.inf)
    if above is not None:
        out[0, 1:] = above
    else:
        out[0, 0] = 0
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        if band is not None:
            i = i[np.abs((i + first) * max(m - 1, 1) / max(rows - 1, 1) - (d - i)) <= band]
        j = d - i
        before = np.minimum(np.minimum(out[i, j], out[i, j + 1]), out[i + 1, j])
        out[i + 1, j + 1] = cost[i, j] + (np.where(i == 0, 0, before) if free else before)
    return out[1:, 1:]


def _back(acc: np.ndarray, i: int, j: int, method: str) -> list[tuple[int, int]]:
    """Steps from a cell to row 0 (and column 0, if classic), the cell itself first; of equal steps diagonal, then up, then left."""
    path = [(i, j)]
    while i > 0 or (j > 0 and method == "classic"):
        if i == 0:
            j -= 1
        elif j == 0:
            i -= 1
        else:
            _, i, j = min((acc[a, b], a, b) for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
        path.append((i, j))
    return path


def warping_path(acc: np.ndarray, method: str = "classic", end: int | None = None) -> list[tuple[int, int]]:
    """The path back from the last cell, or from the best (or given) end in the last row."""
    j = acc.shape[1] - 1 if method == "classic" else int(acc[-1].argmin()) if end is None else end
    return _back(acc, acc.shape[0] - 1, j, method)[::-1]


def align(query: np.ndarray, reference: np.ndarray, metric: str = "cosine", method: str = "classic", end: int | None = None, band: int | None = None):
    """(distance, path, cost, accumulated) of two sequences."""
    cost = cost_matrix(query, reference, metric)
    acc = accumulate(cost, method, band)
    path = warping_path(acc, method, end)
    return float(acc[path[-1]]), path, cost, acc


def align_in_bands(query: np.ndarray, reference: np.ndarray, metric: str = "cosine", method: str = "classic", end: int | None = None, band: int | None = None, cells: int = CELLS):
    """(distance, path) as ``align`` finds them, with about ``cells`` cells held at a time besides one row for each band of rows.

    Bands are accumulated from the top, each from the last row of the one before; the path goes back through them, and each is computed again.
    """
    n, m = len(query), len(reference)
    height = max(1, min(n, cells // max(m, 1)))
    part = lambda a, above: accumulate(cost_matrix(query[a : a + height], reference, metric), method, band, above, a, n)
    tops, acc = [None], None
    for a in range(0, n, height):
        acc = part(a, tops[-1])
        tops.append(acc[-1].copy())
    j = m - 1 if method == "classic" else int(acc[-1].argmin()) if end is None else end
    distance, path, i = float(acc[-1][j]), [], n - 1
    for a in reversed(range(0, n, height)):
        k = a // height
        if a + height < n:
            acc = part(a, tops[k])
        # With the row above a band, the walk stops in it: at the cell where the next band takes over.
        own = acc if a == 0 else np.vstack((tops[k], acc))
        shift = a if a == 0 else a - 1
        steps = _back(own, i - shift, j, method if a == 0 else "subsequence")
        i, j = steps[-1][0] + shift, steps[-1][1]
        path += [(r + shift, c) for r, c in (steps if a == 0 else steps[:-1])]
    return distance, path[::-1]


def dtw(
    query: DataFrame, reference: DataFrame, on: list[str], order: str, metric: str = "cosine", method: str = "classic",
    keep_artifacts: bool = False, end: int | None = None, band: int | None = None, embedding: str = "embedding",
) -> DataFrame:
    """``on``, distance, path[, cost, accumulated]: one row for each pair of sequences ``on`` that both tables have.

    Sequences are sorted by ``order``. A pair is one task's work, and pairs run in parallel. A task holds the two sequences and about ``CELLS`` cells
    of their matrix, however long they are; only ``keep_artifacts`` asks for the whole matrices.
    """
    if method not in METHODS:
        raise NotImplementedError(f"method must be one of {METHODS}")

    def run(key: tuple[Any, ...], both: pd.DataFrame) -> pd.DataFrame:
        q, r = both[both[SIDE] == 0], both[both[SIDE] == 1]
        names = [*on, "distance", "path", *(["cost", "accumulated"] if keep_artifacts else [])]
        if not len(q) or not len(r):
            return pd.DataFrame({n: pd.Series(dtype=object) for n in names})
        a, b = (np.stack(x.sort_values(order)[embedding].to_numpy()).astype(float) for x in (q, r))
        if keep_artifacts:
            distance, path, cost, acc = align(a, b, metric, method, end, band)
        else:
            distance, path = align_in_bands(a, b, metric, method, end, band)
        row = [*key, distance, [{"i": i, "j": j} for i, j in path]]
        row += [cost.tolist(), acc.tolist()] if keep_artifacts else []
        return pd.DataFrame([row], columns=names)

    cols = [*on, order, embedding]
    keys = ", ".join(f"`{k}` {query.schema[k].dataType.simpleString()}" for k in on)
    q, r = (x.where(F.col(embedding).isNotNull()).select(*cols, F.lit(k).alias(SIDE)) for k, x in enumerate((query, reference)))
    return q.unionByName(r).groupBy(*on).applyInPandas(run, f"{keys}, {RESULT}{ARTIFACTS if keep_artifacts else ''}")


def accumulated_row(cost: Column, method: str = "classic") -> Column:
    """The last row of the accumulated matrix of ``cost`` array<array<double>>, as a fold of built-in functions."""
    first = F.element_at(cost, 1)
    start = first if method == "subsequence" else F.transform(first, lambda _, k: F.aggregate(F.slice(first, F.lit(1), k + 1), F.lit(0.0), lambda s, x: s + x))

    def step(before: Column, row: Column) -> Column:
        def cell(done: Column, k: Column) -> Column:
            up, diagonal = F.get(before, k), F.when(k > 0, F.get(before, k - 1))
            left = F.when(k > 0, F.get(done, k - 1))
            return F.concat(done, F.array(F.get(row, k) + F.least(up, diagonal, left)))

        none = F.array().cast("array<double>")
        return F.aggregate(F.sequence(F.lit(0), F.size(row) - 1), none, cell)

    return F.aggregate(F.slice(cost, F.lit(2), F.size(cost)), start, step)
