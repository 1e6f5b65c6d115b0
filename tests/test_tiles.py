import numpy as np
import pytest

from cueline.operators import dtw, tiles

KIND = "film string, at int, embedding array<double>, distance string"


def sequences(spark, own):
    rows = [(f, 3 * i, x.tolist(), "x") for f, v in own.items() for i, x in enumerate(v)] + [(f, 1, None, None) for f in own]
    return spark.createDataFrame(rows, KIND)


def paths(found):
    out = {}
    for film, i, j, distance in found.collect():
        out.setdefault(film, []).append((i, j, distance))
    return {f: (rows[0][2], [(i, j) for i, j, _ in sorted(rows)]) for f, rows in out.items()}


@pytest.mark.parametrize("method, tile, end, band", [("classic", 4, None, None), ("subsequence", 3, None, None), ("subsequence", 4, 5, None), ("classic", 3, None, 1), ("classic", 64, None, None)])
def test_tiles_equal_the_whole_matrix(spark, method, tile, end, band):
    rng = np.random.default_rng(tile)
    # Whole numbers have many ties.
    a, b = ({f: rng.integers(-2, 3, size=(n, 2)).astype(float) for f, n in sizes.items()} for sizes in ({"x": 14, None: 4, "y": 1, "only a": 3}, {"x": 11, None: 9, "y": 6, "only b": 2}))
    found = paths(tiles.dtw_tiles(sequences(spark, a), sequences(spark, b), ["film"], "at", "manhattan", method, end, band, tile=tile))
    for film in ("x", None, "y"):
        distance, path, _, _ = dtw.align(a[film], b[film], "manhattan", method, end, band)
        if distance == np.inf:
            assert film not in found
        else:
            assert found.pop(film) == (distance, path)
    assert not found


def test_narrow_bands_cross_corners_only(spark):
    rng = np.random.default_rng(5)
    own = {"x": rng.normal(size=(12, 3))}
    table = sequences(spark, own)
    assert paths(tiles.dtw_tiles(table, table, ["film"], "at", "euclidean", band=0, tile=3)) == {"x": (0.0, [(i, i) for i in range(12)])}
    assert paths(tiles.dtw_tiles(table, table, ["film"], "at", "euclidean", band=2, tile=3, parts=3)) == {"x": (0.0, [(i, i) for i in range(12)])}


def test_parts_and_walks_of_tiles():
    rng = np.random.default_rng(6)
    cost = rng.random((7, 9))
    whole = dtw.accumulate(cost)
    sums = tiles.tile_sums(cost[3:, 4:], np.r_[whole[2, 3], whole[2, 4:]], np.r_[whole[2, 3], whole[3:, 3]])
    assert np.array_equal(sums[1:, 1:], whole[3:, 4:])
    cells, out = tiles.walk_out(sums, 3, 4, False, False)
    assert [(i + 3, j + 4) for i, j in (*cells, out)] == dtw.warping_path(whole)[::-1][: len(cells) + 1]


def test_edges(spark):
    none = spark.createDataFrame([], KIND)
    some = sequences(spark, {"x": np.ones((2, 2))})
    assert tiles.dtw_tiles(none, some, ["film"], "at").columns == ["film", "i", "j", "distance"]
    assert tiles.dtw_tiles(none, some, ["film"], "at").count() == tiles.dtw_tiles(some, none, ["film"], "at").count() == 0
    assert tiles.dtw_tiles(some, some, ["film"], "at", method="subsequence", end=7).count() == 0
    with pytest.raises(NotImplementedError):
        tiles.dtw_tiles(some, some, ["film"], "at", method="open")
