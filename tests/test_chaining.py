import random

import numpy as np
import pytest

from cueline.operators import chaining

KIND = "film string, i long, j long, weight double"


def brute(anchors, gap, least=0.0):
    """Chains of (i, j, weight) by comparing all pairs."""
    found = {}
    for i, j, w in sorted(anchors):
        best = max(((s + gap * (a + b), a, b) for (a, b), (s, _, _) in found.items() if a < i and b < j), default=(float("-inf"), 0, 0))
        gain = best[0] - gap * (i + j - 2)
        found[i, j] = (w + gain, best[1:], w) if gain > 0 else (w, None, w)
    chains, taken = [], set()
    for end in sorted(found, key=lambda e: (-found[e][0], e)):
        own, at = [], end
        while at and at not in taken:
            own.append(at)
            taken.add(at)
            at = found[at][1]
        if own:
            first = own[-1]
            chains.append((found[end][0] - (found[first][0] - found[first][2]), end, own[::-1]))
    chains = sorted((c for c in chains if c[0] >= least), key=lambda c: (-c[0], c[1]))
    return [(n, k, *a, found[a][2], found[a][0], c[0]) for n, c in enumerate(chains, 1) for k, a in enumerate(c[2], 1)]


def run(spark, rows, **options):
    found = chaining.chain_anchors(spark, spark.createDataFrame(rows, KIND), ["film"], **options)
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("tile", [7, 11, 1000])
def test_chains_are_those_of_all_pairs(spark, tile):
    rng = random.Random(tile)
    rows = [(f, i, j, float(rng.randrange(1, 9))) for f, n in (("a", 12), ("b", 30), ("c", 1)) for i, j in {(rng.randrange(n), rng.randrange(n)) for _ in range(3 * n)}]
    for gap in (0.0, 0.25, 1.0):
        expected = sorted((f, *r) for f in "abc" for r in brute([x[1:] for x in rows if x[0] == f], gap))
        assert run(spark, rows, gap=gap, tile=tile) == expected
        if tile == 1000:
            continue
        break


def test_moved_scenes_are_chains_of_their_own(spark):
    scenes = [(0, 20), (10, 0), (20, 10), (30, 30)]  # the second and third of the script come first
    rows = [("x", a + k, b + k, 1.0) for a, b in scenes for k in range(10)] + [("x", 3, 38, 1.0)]
    found = run(spark, rows, gap=0.01, least=2.0, tile=16)
    by_chain = {}
    for _, chain, _, i, j, *_ in found:
        by_chain.setdefault(chain, []).append((i, j))
    assert len(by_chain) == 2 and len(by_chain[1]) == 30 and by_chain[2] == [(k, 20 + k) for k in range(10)]
    assert (3, 38) not in {p for own in by_chain.values() for p in own}


def test_gaps_are_priced(spark):
    rows = [("x", 0, 0, 1.0), ("x", 5, 5, 1.0)]
    assert [r[1] for r in run(spark, rows, gap=0.1)] == [1, 1]  # 8 positions are skipped
    assert [r[1] for r in run(spark, rows, gap=0.2)] == [1, 2]


def test_edges(spark):
    assert run(spark, []) == []
    rows = [("x", 1, 1, 1.0), ("x", 1, 1, 3.0), ("x", None, 1, 1.0), ("x", 2, 2, float("nan")), ("x", 3, 3, -1.0), ("x", 4, 4, float("inf")), (None, 1, 1, 1.0)]
    assert run(spark, rows) == [("x", 1, 1, 1, 1, 3.0, 3.0, 3.0)]
    wide = spark.createDataFrame([("x", 1, 1, 1.0, 9, "k")], KIND + ", p int, kind string")
    assert [tuple(r) for r in chaining.chain_anchors(spark, wide, ["film"]).collect()] == [("x", 1, 1, 1, 1, 1.0, 1.0, 1.0)]


def test_a_task_has_one_tile(spark):
    rows = [("x", k, k, 1.0) for k in range(300)]
    assert len(run(spark, rows, tile=120)) == 300
    assert max(r[6] for r in run(spark, rows, tile=120)) == 300.0


def test_a_dense_tile_hands_on_few_anchors():
    rng = np.random.default_rng(1)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(200), np.arange(200), indexing="ij"))
    weight, none = rng.integers(1, 9, len(i)).astype(float), (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    *_, value = chaining.chain_tile(i, j, weight, 0.5, none, none, none)
    sent = chaining._bests(value, i, j, np.arange(len(i))) | chaining._bests(value, i, j, np.lexsort((i, j)))
    assert 0 < sent.sum() < len(i) / 10


@pytest.mark.parametrize("gap", [0.0, 0.5])
def test_dense_anchors_over_tiles(spark, gap):
    rng = random.Random(3)
    rows = [("x", i, j, float(rng.randrange(1, 9))) for i in range(24) for j in range(24) if rng.random() < 0.6]
    assert run(spark, rows, gap=gap, tile=9) == sorted(("x", *r) for r in brute([x[1:] for x in rows], gap))
