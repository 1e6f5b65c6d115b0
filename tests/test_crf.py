import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.operators import anchors, crf, hmm
from tests.test_hmm import all_paths

KIND = "film string, script string, i long, j long, f double, g double, pair string"
MOVES = [-2.0, -0.7, -0.3, -1.5, -2.5]


def table(spark, own):
    return spark.createDataFrame([(a, b, i, j, *map(float, f[i, j]), "x") for (a, b), f in own.items() for i, j in np.ndindex(f.shape[:2]) if f[i, j, 0] > -np.inf], KIND)


def field(spark, cells, block=2):
    return crf.Field(spark, cells, ["film", "script"], ["film"], F.col("film") == F.col("script"), ["f", "g"], block)


def by_hand(own, weights, moves):
    z = {k: np.logaddexp.reduce([v for v, _ in all_paths(f @ np.array(weights), moves)] or [-np.inf]) for k, f in own.items()}
    groups = {a for a, _ in own if z.get((a, a), -np.inf) > -np.inf}
    return sum(z[a, a] - np.logaddexp.reduce([v for (x, _), v in z.items() if x == a]) for a in groups) / len(groups)


def test_objective_and_gradient(spark):
    rng = np.random.default_rng(1)
    own = {(a, b): rng.normal(size=(n, m, 2)) for a, n in (("x", 4), ("y", 3)) for b, m in (("x", 3), ("y", 4), ("z", 2))}
    own["w", "x"] = rng.normal(size=(2, 2, 2))  # no right candidate
    weights, step = [0.7, -0.4], 1e-5
    value, gradient = field(spark, table(spark, own)).climb(weights, MOVES)
    assert value == pytest.approx(by_hand(own, weights, MOVES))
    start = np.array([*weights, *MOVES])
    shifts = [start + step * np.eye(7)[k] * s for k in range(7) for s in (1, -1)]
    values = [by_hand(own, s[:2], s[2:].tolist()) for s in shifts]
    assert gradient == pytest.approx([(a - b) / (2 * step) for a, b in zip(values[::2], values[1::2])], abs=1e-6)


def test_learned_weights_find_planted_alignments(spark):
    rng = np.random.default_rng(2)
    lines = {film: rng.normal(size=(14, 6)) for film in "abcd"}
    places = {film: np.clip(np.cumsum(rng.choice([0, 1, 2], 12, p=[0.1, 0.7, 0.2])), 0, 13) for film in "abcd"}
    said = {film: lines[film][places[film]] + rng.normal(0, 0.4, (12, 6)) for film in "abcd"}
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    own = {(a, b): np.stack((unit(said[a]) @ unit(lines[b]).T, rng.normal(0, 2, (12, 14))), 2) for a in "abcd" for b in "abcd"}
    cells, start = table(spark, own), np.log(np.full(5, 0.2)).tolist()
    weights, moves, seen = field(spark, cells, 8).fit([1.0, 1.0], start, 6)
    assert seen == sorted(seen) and seen[-1] > seen[0]

    def share(weights, moves):
        right = cells.where("film = script").withColumn("value", crf.weighted(["f", "g"], weights))
        return np.mean([places[f][i] == j for f, i, j, _ in hmm.best_path(spark, right, ["film"], moves).collect()])

    assert weights[0] > abs(weights[1]) and share(weights, moves) > share([1.0, 1.0], start)


def test_edges(spark):
    none = spark.createDataFrame([], KIND)
    value, gradient = field(spark, none).climb([1.0, 1.0], MOVES)
    assert value == 0 and not gradient.any()
    nan, gone = float("nan"), float("-inf")
    rows = [("a", "a", 0, 0, 1.0, 0.0, ""), ("a", "a", 0, 0, 0.5, 2.0, ""), ("a", "a", 0, 1, nan, 0.0, ""), ("a", "a", 1, 0, None, 0.0, ""), ("a", None, 0, 0, 2.0, 0.0, "")]
    rows += [("b", "b", 0, 5, 1.0, 0.0, ""), ("b", "b", 1, 0, 1.0, 0.0, ""), ("b", "a", 0, 0, 0.0, 0.0, "")]  # no jump leads from state 5 to 0
    value, gradient = field(spark, spark.createDataFrame(rows, KIND)).climb([1.0, 1.0], [gone, 0.0, 0.0])
    # One group: the right candidate scores 1 + 2 and the other one 2.
    assert value == pytest.approx(3 - np.logaddexp(3, 2)) and gradient[:2] == pytest.approx(np.array([-1, 2]) * (1 - np.exp(value)))
    with pytest.raises(ValueError):
        field(spark, none).climb([1.0], MOVES)
    with pytest.raises(ValueError):
        crf.Field(spark, none, ["film"], ["script"], F.lit(True), ["f"])


def test_products_equal_a_table_of_features(spark):
    rng = np.random.default_rng(5)
    rows = [(s, c, n, i, rng.normal(size=3).tolist()) for s, n in (("a", 5.0), ("b", 4.0)) for c in "xy" for i in range(int(n))]
    table = spark.createDataFrame(rows, "name string, side string, n double, i long, embedding array<double>")
    films = table.where("side = 'x'").withColumnRenamed("name", "film").crossJoin(table.select(F.col("name").alias("script")).distinct())
    scripts = table.where("side = 'y'").withColumnRenamed("name", "script").crossJoin(table.select(F.col("name").alias("film")).distinct())
    products = hmm.Products(films, scripts, "i", lambda value, i, j, n: np.stack((value, 1 - i / n + 0 * j), 2), ("n",))
    cells = anchors.close_pairs(films, scripts, ["film", "script"], "i", -2.0).withColumnRenamed("value", "f")
    cells = cells.join(films.select("film", "n").distinct(), "film").withColumn("g", 1 - F.col("i") / F.col("n"))
    (value, gradient), (other, expected) = (field(spark, x).climb([0.7, -0.4], MOVES) for x in (products, cells))
    assert value == pytest.approx(other) and gradient == pytest.approx(expected)
