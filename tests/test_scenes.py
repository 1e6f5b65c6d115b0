import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.operators import anchors, scenes

KIND = "film string, scene long, window long, cost double"


def brute(costs, jump, penalty, skip):
    """The least total over all placements."""
    n, m = costs.shape
    best = float("inf")
    for picks in product([None, *range(m)], repeat=n):
        last, total = -1, 0.0
        for s, w in enumerate(picks):
            if w is None:
                total += skip
            elif abs(w - last - 1) > jump or w == last:
                total = float("inf")
            else:
                total, last = total + costs[s, w] + penalty * abs(w - last - 1), w
        best = min(best, total)
    return best


def worth(costs, windows, jump, penalty, skip):
    last, total = -1, 0.0
    for s, w in enumerate(windows):
        if w is None:
            total += skip
        else:
            assert w != last and abs(w - last - 1) <= jump
            total, last = total + costs[s, w] + penalty * abs(w - last - 1), w
    return total


@pytest.mark.parametrize("seed", range(25))
def test_placements_are_the_cheapest_of_all(seed):
    rng = np.random.default_rng(seed)
    costs = rng.integers(0, 10, (rng.integers(1, 5), rng.integers(1, 6))).astype(float)
    costs[rng.random(costs.shape) < 0.1] = np.inf
    for jump, penalty, skip in ((0, 0.0, 5.0), (1, 0.5, 4.0), (3, 1.0, 6.0), (9, 0.25, 50.0)):
        total, windows = scenes.place(costs, jump, penalty, skip)
        assert total == brute(costs, jump, penalty, skip) == worth(costs, windows, jump, penalty, skip)


def test_moved_and_deleted_scenes(spark):
    order = [0, 2, 1, 4, 5, None, 6]  # the second and third scenes are swapped, the sixth is cut
    rows = [("x", s, w, 0.1 if w == order[s] else 0.9) for s in range(7) for w in range(8)]
    found = scenes.align_scenes(spark.createDataFrame(rows, KIND), ["film"], jump=3, penalty=0.01, skip=0.5).orderBy("scene").collect()
    assert [r["window"] for r in found] == order
    near = scenes.align_scenes(spark.createDataFrame(rows, KIND), ["film"], jump=0, penalty=0.01, skip=0.5).orderBy("scene").collect()
    assert [r["window"] for r in near] != order


def test_edges(spark):
    assert scenes.align_scenes(spark.createDataFrame([], KIND), ["film"]).count() == 0
    rows = [("x", 0, 0, None), ("x", 0, 1, float("nan")), ("x", None, 0, 1.0), ("x", 1, None, 1.0), ("y", 0, 0, 0.5), ("y", 0, 0, 0.2), (None, 0, 0, 0.3)]
    found = scenes.align_scenes(spark.createDataFrame([(*r, "k") for r in rows], KIND + ", total string"), ["film"]).collect()
    assert sorted(map(tuple, found), key=str) == sorted([("x", 0, None, None, 1.0), ("y", 0, 0, 0.2, 0.2), (None, 0, 0, 0.3, 0.3)], key=str)


def test_costs_are_mean_distances_of_best_matches(spark):
    rows = [("x", 0, 0, i, v) for i, v in ((0, 0.5), (0, 0.75), (1, 0.25))] + [("x", 0, 1, 0, 1.0)]
    cells = spark.createDataFrame(rows, "film string, scene long, window long, i long, value double")
    assert sorted(map(tuple, scenes.scene_costs(cells, ["film"]).collect())) == [("x", 0, 0, 0.5), ("x", 0, 1, 0.0)]


def test_packed_costs_equal_a_table_of_cells(spark):
    rng = np.random.default_rng(8)
    rows = [(f, s, i, rng.normal(size=3).tolist()) for f, n in (("a", 13), ("b", 4), (None, 3)) for s in "xy" for i in range(n)] + [("a", "x", 30, [1.0, 0.0, 0.0]), ("a", "y", 14, None), ("b", "x", 5, None)]
    table = spark.createDataFrame(rows, "film string, side string, pos int, embedding array<double>")
    a, b = (table.where(f"side = '{s}'") for s in "xy")
    cells = anchors.pairwise(a, b, ["film"], "pos").withColumn("scene", F.floor(F.col("i") / 3)).withColumn("window", F.floor(F.col("j") / 2))
    costs = scenes.scene_costs(cells, ["film"]).withColumn("cost", F.round(F.col("cost") * 1000))
    expected = scenes.align_scenes(costs, ["film"], 2, 15.0, 820.0).collect()
    for block in (2, 1000):
        packed = anchors.best_matches(a, b, ["film"], "pos", 3, 2, block=block)
        assert sorted(map(tuple, scenes.align_packed(packed, ["film"], 2, 15.0, 820.0, 0, 1000).collect()), key=str) == sorted(map(tuple, expected), key=str)
    assert len(expected) == 11 + 2
