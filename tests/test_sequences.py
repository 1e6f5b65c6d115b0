import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.functions import vector
from cueline.operators import anchors, dtw

METHODS = ("classic", "subsequence")


def by_hand(cost, method):
    """The accumulated matrix by its definition, cell by cell."""
    n, m = cost.shape
    out = np.zeros((n, m))
    for i in range(n):
        for j in range(m):
            before = [out[a, b] for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if a >= 0 and b >= 0]
            free = i == 0 and (j == 0 or method == "subsequence")
            out[i, j] = cost[i, j] + (0 if free else min(before))
    return out


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean", "manhattan"])
def test_accumulated_cost(method, metric):
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (1, 7), (6, 1), (5, 9), (12, 4)):
        a, b = rng.normal(size=(n, 3)), rng.normal(size=(m, 3))
        distance, path, cost, acc = dtw.align(a, b, metric, method)
        assert np.allclose(acc, by_hand(cost, method))
        assert distance == pytest.approx(sum(cost[p] for p in path)) == pytest.approx(acc[-1, -1] if method == "classic" else acc[-1].min())
        assert path[-1][0] == n - 1 and path[0][0] == 0 and (method == "subsequence" or path[0][1] == 0)
        assert all((c - a, d - b) in ((0, 1), (1, 0), (1, 1)) for (a, b), (c, d) in zip(path, path[1:]))
        for cells in (1, m, 3 * m, 100 * m):
            assert dtw.align_in_bands(a, b, metric, method, cells=cells) == (pytest.approx(distance), path)


def test_ties_go_diagonal_then_up_then_left():
    assert dtw.warping_path(np.zeros((3, 3))) == [(0, 0), (1, 1), (2, 2)]
    assert dtw.warping_path(np.zeros((3, 2))) == [(0, 0), (1, 0), (2, 1)]
    assert dtw.warping_path(np.zeros((2, 3)), "subsequence", end=2) == [(0, 1), (1, 2)]


def test_window_and_errors():
    a = np.arange(6.0)[:, None]
    assert dtw.align(a, a, "euclidean", band=0)[1] == [(i, i) for i in range(6)]
    assert dtw.align_in_bands(a, a, "euclidean", band=1, cells=6)[1] == [(i, i) for i in range(6)]
    with pytest.raises(NotImplementedError):
        dtw.accumulate(np.ones((2, 2)), "open")
    with pytest.raises(ValueError):
        dtw.cost_matrix(np.ones(3), np.ones((3, 1)))
    with pytest.raises(ValueError):
        dtw.cost_matrix(np.ones((3, 1)), np.ones((3, 1)), "hamming")


@pytest.mark.parametrize("method", METHODS)
def test_dtw_on_tables(spark, method):
    rng = np.random.default_rng(8)
    rows = [(k, i, rng.normal(size=2).tolist()) for k in ("x", "y") for i in range(9)] + [("x", 99, None)]
    table = spark.createDataFrame(rows, "film string, at int, embedding array<double>")
    a, b = table.where("at % 3 = 0"), table.where("at % 3 > 0")
    found = {r["film"]: r for r in dtw.dtw(a, b, ["film"], "at", "euclidean", method, keep_artifacts=True).collect()}
    plain = {r["film"]: r for r in dtw.dtw(a, b.unionByName(spark.createDataFrame([("z", 1, [0.0, 0.0])], table.schema)), ["film"], "at", "euclidean", method).collect()}
    for k in ("x", "y"):
        q, r = (np.array([e for f, i, e in rows if f == k and e and (i % 3 == 0) == side]) for side in (True, False))
        distance, path, cost, acc = dtw.align(q, r, "euclidean", method)
        assert found[k]["distance"] == plain[k]["distance"] == pytest.approx(distance)
        assert [tuple(c) for c in found[k]["path"]] == [tuple(c) for c in plain[k]["path"]] == path
        assert np.allclose(found[k]["cost"], cost) and np.allclose(found[k]["accumulated"], acc)
        row = spark.createDataFrame([(cost.tolist(),)], "c array<array<double>>").select(dtw.accumulated_row(F.col("c"), method).alias("r")).first()["r"]
        assert np.allclose(row, acc[-1])
    assert set(plain) == {"x", "y"}


def test_measures(spark):
    row = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = map(F.col, "abz")
    values = row.select(vector.norm(a), vector.normalize(a), vector.normalize(z), vector.cosine(a, b), vector.cosine(a, z), vector.euclidean(a, b), vector.manhattan(a, b), vector.similarity("euclidean", a, b), vector.distance("dot", a, b)).first()
    flat = [y for x in values for y in (x if isinstance(x, list) else [x])]
    assert flat == pytest.approx([5.0, 0.6, 0.8, 0.0, 0.0, 0.6, 0.0, 20**0.5, 6.0, -(20**0.5), -2.0])
    with pytest.raises(ValueError):
        vector.similarity("hamming", a, b)


def test_anchors(spark):
    rows = [("f", i, x) for i, x in enumerate([[1.0, 0.0], [0.0, 1.0], [0.7, 0.71], [1.0, 0.01]])]
    table = spark.createDataFrame(rows, "film string, id int, embedding array<double>")
    a, b = table.where("id < 2"), table.where("id >= 2")
    pairs = anchors.pairwise(a, b, ["film"], "id")
    assert {(r["i"], r["j"]) for r in anchors.anchor_cells(pairs, ["film"], 0.6).collect()} == {(0, 2), (0, 3), (1, 2)}
    assert {(r["i"], r["j"]) for r in anchors.anchor_cells(pairs, ["film"], 0.6, most=2).collect()} == set()
    assert {(r["i"], r["j"]) for r in anchors.mutual_best(a, b, ["film"], "id").collect()} == {(0, 3), (1, 2)}
    left, right = anchors.anchors(a, b, ["film"], "id", 0.9)
    assert [r["id"] for r in left.collect()] == [0] and [r["id"] for r in right.collect()] == [3]


@pytest.mark.parametrize("metric", vector.METRICS)
def test_blocked_pairs_equal_all_pairs(spark, metric):
    rng = np.random.default_rng(4)
    rows = [(k, i, rng.integers(-2, 3, size=4).tolist()) for k, n in (("x", 40), ("y", 5), (None, 4)) for i in range(n)] + [("x", 99, None), ("z", 1, [1, 0, 0, 0])]
    table = spark.createDataFrame([(k, i, e and [float(x) for x in e]) for k, i, e in rows], "film string, id int, embedding array<double>")
    a, b = table.where("id % 2 = 0"), table.where("id % 2 = 1")
    pairs = {(r["film"], r["i"], r["j"]): r["value"] for r in anchors.pairwise(a, b, ["film"], "id", metric).collect()}
    for block in (3, 512):
        found = {(r["film"], r["i"], r["j"]): r["value"] for r in anchors.close_pairs(a, b, ["film"], "id", -1.3, metric, block=block).collect()}
        assert found == pytest.approx({k: v for k, v in pairs.items() if v > -1.3})
        best = {(r["film"], r["i"], r["j"]) for r in anchors.mutual_best(a, b, ["film"], "id", metric, block=block).collect()}
        top = {}
        for side in (1, 2):
            for k, v in sorted(pairs.items(), key=lambda p: (-round(p[1], 9), p[0][3 - side])):
                top.setdefault((side, k[0], k[side]), k)
        assert best == {k for (side, *_), k in top.items() if side == 1} & {k for (side, *_), k in top.items() if side == 2}


@pytest.mark.parametrize("metric", vector.METRICS)
def test_all_pairs_by_blocks_equal_all_pairs(spark, metric):
    rng = np.random.default_rng(6)
    rows = [(k, i, rng.normal(size=3).tolist()) for k, n in (("x", 20), ("y", 5), (None, 4)) for i in range(n)]
    rows += [("x", 97, [1.0, None, 2.0]), ("x", 98, [0.0, 0.0, 0.0]), ("x", 99, None), ("y", 100, [1.0, 2.0]), ("y", 101, [3.0, 1.0]), ("z", 1, [1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "film string, id int, embedding array<double>")
    a, b = table.where("id % 2 = 0"), table.where("id % 2 = 1")
    for kind in ("similarity", "distance"):
        expected = {(r["film"], r["i"], r["j"]): r["value"] for r in anchors.pairwise(a, b, ["film"], "id", metric, kind).collect()}
        found = {(r["film"], r["i"], r["j"]): r["value"] for r in anchors.all_pairs(a, b, ["film"], "id", metric, kind, block=3).collect()}
        assert {k for k, v in found.items() if v is None} == {k for k, v in expected.items() if v is None} and found.keys() == expected.keys()
        assert {k: v for k, v in found.items() if v is not None} == pytest.approx({k: v for k, v in expected.items() if v is not None})
    plan = anchors.all_pairs(a, b, ["film"], "id", metric)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan  # pairs are not measured one by one


def test_rounding():
    assert anchors.rounded(np.array([0.5, -0.5, 1.5, 0.49999999999999994, -2.5, 1e300]), 0).tolist() == [1, -1, 2, 0, -3, 1e300]
    assert anchors.rounded(np.array([0.1234565, -0.1234564]), 6).tolist() == [0.123457, -0.123456]
