from itertools import product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.operators import anchors, hmm

KIND = "film string, i long, j long, value double"


def all_paths(cells, moves):
    """(log score, states) of every allowed path."""
    jump = len(moves) // 2
    for states in product(range(cells.shape[1]), repeat=len(cells)):
        steps = [b - a for a, b in zip(states, states[1:])]
        if all(abs(d) <= jump for d in steps):
            value = sum(cells[t, j] for t, j in enumerate(states)) + sum(moves[d + jump] for d in steps)
            if value > -np.inf:
                yield value, states


def films(seed, integers=False):
    rng = np.random.default_rng(seed)
    out = {}
    for k in range(3):
        cells = rng.integers(0, 4, (rng.integers(1, 6), rng.integers(1, 5))).astype(float) if integers else rng.normal(size=(rng.integers(2, 6), rng.integers(1, 5)))
        cells[(rng.random(cells.shape) < 0.1)] = -np.inf
        cells[:, 0] = np.maximum(cells[:, 0], -5)
        cells[0, -1] = np.maximum(cells[0, -1], -5)  # the last state has a cell
        out[f"f{k}" if k else None] = cells
    return out


def table(spark, own):
    rows = [(f, i, j, float(v)) for f, c in own.items() for (i, j), v in np.ndenumerate(c)]
    return spark.createDataFrame([(*r, "x") for r in rows], KIND + ", pair string")


@pytest.mark.parametrize("seed, block", [(1, 2), (2, 1), (3, 64)])
def test_best_paths_equal_the_best_of_all(spark, seed, block):
    own, moves = films(seed, True), [-2.0, -1.0, -1.0, 0.0, -1.0]
    found = {}
    for f, i, j, total in hmm.best_path(spark, table(spark, own), ["film"], moves, block).collect():
        found.setdefault(f, []).append((i, j, total))
    for film, cells in own.items():
        best = max(v for v, _ in all_paths(cells, moves))
        # Of equal paths the one whose later states are lowest.
        states = min((s[::-1] for v, s in all_paths(cells, moves) if v == best))[::-1]
        assert sorted(found[film]) == [(t, j, best) for t, j in enumerate(states)]


@pytest.mark.parametrize("seed, block", [(4, 2), (5, 64)])
def test_posteriors_and_jumps_equal_sums_over_all_paths(spark, seed, block):
    own, moves = films(seed), [-2.0, -0.7, -0.3, -1.5, -2.5]
    found = {(f, i, j): (p, z) for f, i, j, p, z in hmm.posteriors(spark, table(spark, own), ["film"], moves, 0.0, block).collect()}
    counts, likelihood, n = np.zeros(5), 0.0, 0
    for film, cells in own.items():
        paths = list(all_paths(cells, moves))
        total = np.logaddexp.reduce([v for v, _ in paths])
        likelihood += total
        for (i, j), _ in np.ndenumerate(cells):
            expected = sum(np.exp(v - total) for v, s in paths if s[i] == j)
            if expected > 0:
                n += 1
                assert np.allclose(found[film, i, j], (expected, total))
        for v, s in paths:
            for a, b in zip(s, s[1:]):
                counts[b - a + 2] += np.exp(v - total)
    assert len(found) == n
    fitted, seen = hmm.fit_moves(spark, table(spark, own), ["film"], moves, 1, block)
    assert np.allclose(np.exp(fitted), counts / counts.sum()) and np.allclose(seen, [likelihood])


def test_likelihood_never_falls_and_jumps_are_found(spark):
    rng = np.random.default_rng(7)
    jumps, own = [], {}
    for film in "abc":
        states = np.clip(np.cumsum(rng.choice([0, 1, 2], 40, p=[0.1, 0.7, 0.2])), 0, 60)
        jumps += list(np.diff(states))
        cells = rng.normal(0, 0.3, (40, 61))
        cells[np.arange(40), states] += 6
        own[film] = cells
    moves, seen = hmm.fit_moves(spark, table(spark, own), ["film"], list(np.log(np.full(5, 0.2))), 4, 16)
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0]
    assert np.allclose(np.exp(moves), [np.mean(np.array(jumps) == d) for d in range(-2, 3)], atol=0.05)


def test_edges(spark):
    moves = [float("-inf"), 0.0, 0.0]
    none = spark.createDataFrame([], KIND)
    assert hmm.best_path(spark, none, ["film"], moves).count() == hmm.posteriors(spark, none, ["film"], moves).count() == 0
    assert hmm.fit_moves(spark, none, ["film"], moves, 1) == (moves, [0.0])
    rows = [("x", 0, 1, 1.0), ("x", 0, 1, 2.0), ("x", 70, 1, float("nan")), ("x", 90, 2, 1.0), ("x", None, 0, 1.0), ("x", 1, None, 1.0), ("x", 3, 0, None)]
    rows += [("y", 0, 5, 1.0), ("y", 1, 0, 1.0)]  # no jump leads from state 5 to 0
    cells = spark.createDataFrame(rows, KIND)
    assert sorted(map(tuple, hmm.best_path(spark, cells, ["film"], moves).collect())) == [("x", 0, 1, 3.0), ("x", 90, 2, 3.0)]
    assert sorted(r[:4] for r in hmm.posteriors(spark, cells, ["film"], moves).collect()) == [("x", 0, 1, 1.0), ("x", 90, 2, 1.0)]
    with pytest.raises(ValueError):
        hmm.best_path(spark, cells, ["film"], [0.0, 0.0])


def test_products_equal_a_table_of_their_cells(spark, monkeypatch):
    monkeypatch.setattr(hmm, "PART", 1)
    monkeypatch.setattr(hmm, "CHUNK", 3)
    rng, moves = np.random.default_rng(9), [-2.0, -0.7, -0.3, -1.5, -2.5]
    rows = [(f, side, i, rng.normal(size=3).tolist()) for f in ("a", "b", None) for side, n in (("x", 7), ("y", 8)) for i in range(n)]
    rows += [("a", "x", 8, None), ("a", "x", 9, [1.0, float("nan"), 0.0]), ("a", "x", 11, [0.0, 0.0, 0.0]), ("a", "y", 8, [float("inf"), 0.0, 0.0]), ("a", "y", 9, [1.0, 0.0, 0.0]), ("c", "x", 0, [1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "film string, side string, id int, embedding array<float>")
    a, b = (table.where(f"side = '{s}'") for s in "xy")
    cells = anchors.close_pairs(a, b, ["film"], "id", -2.0).withColumn("value", F.col("value") * 3)
    products = hmm.Products(a, b, "id", lambda value, i, j: value * 3)
    for run in (lambda x: hmm.best_path(spark, x, ["film"], moves, 2), lambda x: hmm.posteriors(spark, x, ["film"], moves, 0.0, 2)):
        found, expected = (sorted(map(tuple, run(x).collect())) for x in (products, cells))
        off = [(x, y) for x, y in zip(found, expected) if x[:3] != y[:3] or not np.allclose(x[3:], y[3:])]
        assert len(found) == len(expected) > 0 and not off
    assert np.allclose(*(hmm.fit_moves(spark, x, ["film"], moves, 1, 2)[0] for x in (products, cells)))
    with pytest.raises(Exception, match="distinct"):
        hmm.best_path(spark, hmm.Products(a.union(a), b, "id", lambda value, i, j: value), ["film"], moves)


def test_no_cell_is_written(spark):
    folder, rng, n = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")), np.random.default_rng(3), 700
    before = set(folder.rglob("*.parquet"))
    table = spark.createDataFrame([(k, "x", rng.normal(size=2).tolist()) for k in range(n)], "id long, film string, embedding array<float>")
    assert hmm.best_path(spark, hmm.Products(table, table, "id", lambda value, i, j: value), ["film"], [-1.0, 0.0, -1.0]).count() == n
    assert sum(p.stat().st_size for p in set(folder.rglob("*.parquet")) - before if p.is_file()) < 8 * n * n / 8  # an eighth of the cells' bytes


@pytest.mark.parametrize("wide", [1.0, 900.0])
def test_sums_of_narrow_and_wide_vectors(wide):
    rng, moves = np.random.default_rng(1), np.array([-np.inf, -0.5, -0.1, -3.0, -1.0])
    for n in (1, 2, 9):
        x = rng.normal(size=n) * wide
        x[rng.random(n) < 0.2] = -np.inf
        expected = [np.logaddexp.reduce([x[s - d] + moves[d + 2] for d in range(-2, 3) if 0 <= s - d < n] + [-np.inf]) for s in range(n)]
        assert np.allclose(hmm.advance(x, moves, np.logaddexp), expected)
