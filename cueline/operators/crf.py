"""Alignment by a latent conditional random field, whose weights are learned from pairs of sequences without any aligned positions.

A cell (i, j) of a pair has features, and a path of states scores their weighted sum and the scores of its jumps, as in ``hmm``. All that is known is which
sequences belong together: a group has candidates (a film's subtitles with its own screenplay and with others), some of which are right. The
probability of a candidate is its sum over all paths, of those of its group, and weights are climbed to where the right ones are likeliest. The
alignment itself is summed out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.operators.hmm import BLOCK, Products, _between, _Blocks, _moves, marginals, opened


def weighted(features: list[str], weights: list[float]) -> Column:
    """The score of a cell: what ``hmm.best_path`` and ``hmm.posteriors`` take as its value."""
    return reduce(lambda a, b: a + b, [F.col(f) * F.lit(float(w)) for f, w in zip(features, weights)])


def _same(left: str, right: str, on: list[str]) -> Column:
    out = F.lit(True)
    for k in on:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


class Field(_Blocks):
    """The features of all candidates, or the vectors that they are made of, written once in blocks of positions.

    ``cells``: ``on``, i, j and ``features``, or ``Products`` with as many values a cell; ``group``: those columns of ``on`` that candidates share; ``right``: a
    condition on ``on`` that holds for the right ones. Cells with a null or no finite feature are not allowed; of repeated cells the greatest of each feature counts. Other columns
    are not read. A candidate without an allowed path has no probability; a group without a right one that has is left out. Nulls in ``on`` are values as others
    (but not of ``Products``).
    """

    name = "crf"

    def __init__(self, spark: SparkSession, cells: DataFrame | Products, on: list[str], group: list[str], right: Column, features: list[str], block: int = BLOCK):
        if not features or not set(group) <= set(on):
            raise ValueError("a field needs features, and groups that are columns of its pairs")
        self.columns, self.n, self.group, self.right = features, len(features), group, right
        super().__init__(spark, cells, on, block)
        n = self.n
        self.features = self.decode if self.vectors else lambda row, states: np.frombuffer(row.cells).reshape(-1, row.states, n)

    def _features(self, cells: DataFrame) -> DataFrame:
        values = [F.col(f).cast("double").alias(f"_f{k}") for k, f in enumerate(self.columns)]
        known = cells.select(*self.on, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *values).where("i >= 0 and j >= 0")
        for k in range(self.n):
            known = known.where(f"_f{k} > double('-infinity') and _f{k} < double('infinity')")
        return known.select(*self.on, "i", "j", F.array(*[f"_f{k}" for k in range(self.n)]).alias("f"))

    def _save_pairs(self, sizes: DataFrame) -> DataFrame:
        sizes = super()._save_pairs(sizes.withColumn("right", F.coalesce(self.right, F.lit(False))))
        groups = self.rounds.save(sizes.select(*self.group).distinct().withColumn("group", F.monotonically_increasing_id()), "groups")
        return self.rounds.save(sizes.alias("s").join(groups.alias("g"), _same("s", "g", self.group)).select("s.*", "g.group"), "named")

    def climb(self, weights: list[float], moves: list[float]) -> tuple[float, np.ndarray]:
        """(mean log probability of the right candidates of a group, its gradient by ``weights``, then by ``moves``).

        Expected features are summed over all blocks of all candidates; one number for each weight and jump reaches the driver. No groups: zeros.
        """
        steps, w, n = _moves(moves), np.array(weights, float), self.n
        if w.shape != (n,) or not np.isfinite(w).all():
            raise ValueError("weights must be finite, one for each feature")
        features = self.features

        def score(f: np.ndarray) -> np.ndarray:
            allowed = f[..., 0] > -np.inf
            return f @ w if allowed.all() else np.where(allowed, np.where(allowed[..., None], f, 0) @ w, -np.inf)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row, f in opened(batches, features):
                total, found, counts = marginals(np.frombuffer(row.before), np.frombuffer(row.after), score(f), row.first, steps)
                if total > -np.inf:
                    sums = np.einsum("ts,tsn->n", found, np.where(f > -np.inf, f, 0))
                    yield pd.DataFrame({"pair": row.pair, "k": range(-1, n + len(steps)), "value": [total if row.first else 0.0, *sums, *counts]})

        self.decode = lambda row, states: score(features(row, states))
        sums = _between(self, steps).mapInPandas(run, "pair long, k int, value double").groupBy("pair", "k").agg(F.sum("value").alias("value"))
        sums = self.rounds.save(sums, "sums")
        own = sums.where("k = -1").select("pair", F.col("value").alias("z")).join(self.pairs.select("pair", "group", "right"), "pair")
        tops = own.groupBy("group").agg(F.max("z").alias("m"), F.max(F.when(F.col("right"), F.col("z"))).alias("r")).where("r is not null")
        part = own.join(tops, "group").select("pair", "group", F.exp(F.col("z") - F.col("m")).alias("a"), F.when(F.col("right"), F.exp(F.col("z") - F.col("r"))).otherwise(0.0).alias("b"))
        part = self.rounds.save(part, "parts")
        whole = part.groupBy("group").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
        value, groups = whole.join(tops, "group").agg(F.sum(F.col("r") + F.ln("sb") - F.col("m") - F.ln("sa")), F.count("*")).first()
        share = part.join(whole, "group").select("pair", (F.col("b") / F.col("sb") - F.col("a") / F.col("sa")).alias("share"))
        found = dict(sums.where("k >= 0").join(share, "pair").groupBy("k").agg(F.sum(F.col("value") * F.col("share"))).collect())
        gradient = np.array([found.get(k, 0.0) for k in range(n + len(steps))])
        return (value / groups, gradient / groups) if groups else (0.0, gradient)

    def fit(self, weights: list[float], moves: list[float], rounds: int = 10, rate: float = 1.0, ridge: float = 0.01) -> tuple[list[float], list[float], list[float]]:
        """(weights, scores of jumps, objective of the best so far after each round) of the likeliest point that ``rounds`` of climbing meet.

        The objective is that of ``climb``, less ``ridge`` / 2 of the squared weights; it never falls. A step that doesn't rise is taken back and made shorter.
        Jumps of score -inf stay forbidden.
        """
        n, start = self.n, np.array([*weights, *moves], float)
        best, at, gradient, seen = -np.inf, start, np.zeros(len(start)), []
        trial = start
        for _ in range(rounds):
            value, slope = self.climb(trial[:n].tolist(), trial[n:].tolist())
            value -= ridge / 2 * float(trial[:n] @ trial[:n])
            if value > best:
                slope[:n] -= ridge * trial[:n]
                rate *= 1.5 if best > -np.inf else 1
                best, at, gradient = value, trial, slope
            else:
                rate /= 4
            seen.append(best)
            trial = at + rate * gradient
        return at[:n].tolist(), at[n:].tolist(), seen
