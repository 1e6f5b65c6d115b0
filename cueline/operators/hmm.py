"""Alignment by a hidden Markov model: each position of one sequence is emitted by a position, the state, of another.

A cell (i, j) has a log score of position i under state j, and ``moves`` has the log probabilities of jumps of -J to J states from one position to
the next. Positions are cut into blocks. Only a vector of all states is carried over the blocks of a pair, in a stream of one block at a time, forth and
back at once; with the vectors at its borders each block finishes by itself, in parallel. (A block's effect as a banded matrix of 2 * J * 64 + 1 columns would cost the
carrying task about what the block's own cells cost it, and making the matrix some hundred times more.)

Cells are a table, or ``Products`` of two sequences of vectors, of which no cell is ever written or shuffled: tasks compute them from the vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.functions import vector
from cueline.operators.anchors import similarities
from cueline.shared import Rounds

#: Positions of a block; blocks that finish in one task, where the vectors of a pair's states are sent along with them; states whose vectors are one row.
BLOCK, PART, CHUNK = 64, 16, 512
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_BLOCKS = "pair long, part long, side int, block long, first boolean, states int, place array<long>, cells binary, own array<double>"
_NAMES = [x.split()[0] for x in _BLOCKS.split(", ")]
#: Beyond this width of log values sums are taken around each state's own greatest one.
_WIDE = 600.0


@dataclass(frozen=True)
class Products:
    """Cells of all positions of two sequences ``a`` and ``b`` (``on``, ``id``, ``embedding``), in each pair of sequences.

    ``values`` makes cells, or the features of each, of similarities (positions by states), their positions (a column), their states (a row) and ``own``: numeric columns
    of ``a`` with one value for a pair. It must give finite numbers. Positions ``id``, from 0 on, are distinct in a pair. Vectors that are null, or hold a null or no finite
    component, have no cells. A null in ``on`` has no partner.
    """

    a: DataFrame
    b: DataFrame
    id: str
    values: Callable[..., np.ndarray]
    own: tuple[str, ...] = ()
    metric: str = "cosine"
    embedding: str = "embedding"

    def side(self, df: DataFrame, on: list[str], name: str, *own: str) -> DataFrame:
        found = vector.as_double(F.col(self.embedding))
        finite = F.forall(found, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        return df.where(finite & (F.col(self.id) >= 0)).select(*on, F.col(self.id).cast("long").alias(name), found.alias("v"), *own)


def shifted(x: np.ndarray, d: int) -> np.ndarray:
    """``x`` moved up by ``d`` on its last axis, with no way in from outside."""
    out = np.full(x.shape, -np.inf)
    n = x.shape[-1]
    if abs(d) < n:
        out[..., max(d, 0) : n + min(d, 0)] = x[..., max(-d, 0) : n - max(d, 0)]
    return out


def _width(x: np.ndarray) -> float:
    """From the least to the greatest finite value."""
    known = x[x > -np.inf]
    return float(known.max() - known.min()) if len(known) else 0.0


def advance(x: np.ndarray, moves: np.ndarray, add: np.ufunc) -> np.ndarray:
    """States one jump later; ``add`` is logaddexp or maximum."""
    n, jump = len(x), len(moves) // 2
    pad = np.full(n + 2 * jump, -np.inf)
    pad[jump : jump + n] = x
    if add is np.maximum:
        out = pad[2 * jump :] + moves[0]
        for k in range(1, len(moves)):
            np.maximum(out, pad[2 * jump - k : 2 * jump - k + n] + moves[k], out=out)
        return out
    top = moves.max(initial=-np.inf)
    if top > -np.inf and _width(x) < _WIDE and _width(moves) < 100:
        most = x.max(initial=-np.inf)
        most = most if most > -np.inf else 0.0
        np.exp(pad - most, out=pad)
        out = sum(pad[2 * jump - k : 2 * jump - k + n] * move for k, move in enumerate(np.exp(moves - top)))
        with np.errstate(divide="ignore"):
            return np.log(out) + (most + top)
    out = np.full(n, -np.inf)
    for k, move in enumerate(moves):
        out = np.logaddexp(out, pad[2 * jump - k : 2 * jump - k + n] + move)
    return out


def forth(x: np.ndarray, cells: np.ndarray, first: bool, moves: np.ndarray, add: np.ufunc) -> np.ndarray:
    """The vector ``x`` before a block, carried to its end. The first block's first position needs no jump."""
    for t, row in enumerate(cells):
        x = (x if first and t == 0 else advance(x, moves, add)) + row
    return x


def back(x: np.ndarray, cells: np.ndarray, moves: np.ndarray, add: np.ufunc) -> np.ndarray:
    """The vector ``x`` at a block's end, carried to before it."""
    for row in cells[::-1]:
        x = advance(x + row, moves[::-1], add)
    return x


def best_steps(before: np.ndarray, cells: np.ndarray, first: bool, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores at a block's end, the state before each state of each position); of equal ones the lowest."""
    jump, n = len(moves) // 2, cells.shape[1]
    came = np.tile(np.arange(n), (len(cells), 1))
    for t, row in enumerate(cells):
        if first and t == 0:
            before = before + row
            continue
        best, pick = shifted(before, jump) + moves[-1], np.full(n, jump)
        for d in range(jump - 1, -jump - 1, -1):  # the lowest state first
            option = shifted(before, d) + moves[d + jump]
            better = option > best
            best[better], pick[better] = option[better], d
        came[t], before = np.arange(n) - pick, best + row
    return before, came


def marginals(before: np.ndarray, after: np.ndarray, cells: np.ndarray, first: bool, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log likelihood of the pair, posterior of each cell, expected number of each jump) of a block between two border vectors."""
    jump, ahead, behind = len(moves) // 2, [], [after]
    for t, row in enumerate(cells):
        ahead.append((before if first and t == 0 else advance(ahead[-1] if ahead else before, moves, np.logaddexp)) + row)
    for row in cells[:0:-1]:
        behind.append(advance((behind[-1] + row), moves[::-1], np.logaddexp))
    behind = behind[::-1]
    total = float(np.logaddexp.reduce(ahead[-1] + behind[-1]))
    counts = np.zeros(len(moves))
    if total == -np.inf:
        return total, np.zeros(cells.shape), counts
    for t, row in enumerate(cells):
        if first and t == 0:
            continue
        last, rest = ahead[t - 1] if t else before, row + behind[t]
        if _width(last) + _width(rest) < _WIDE:
            most, top = last.max(), rest.max()
            a, b, n = np.exp(last - most), np.exp(rest - top), len(last)
            sums = np.array([a[max(-d, 0) : max(n - max(d, 0), 0)] @ b[max(d, 0) : max(n + min(d, 0), 0)] for d in range(-jump, jump + 1)])
            counts += np.where(sums > 0, sums * np.exp(np.where(sums > 0, moves + (most + top - total), 0)), 0)
        else:
            counts += [np.exp(shifted(last, d) + moves[d + jump] + rest - total).sum() for d in range(-jump, jump + 1)]
    return total, np.exp(np.stack(ahead) + np.stack(behind) - total), counts


def _moves(moves: list[float]) -> np.ndarray:
    out = np.array(moves, float)
    if out.ndim != 1 or len(out) % 2 == 0 or np.isnan(out).any() or (out == np.inf).any():
        raise ValueError("moves must be log probabilities of jumps of -J to J")
    return out


def _array(blob: bytes, states: int) -> np.ndarray:
    return np.frombuffer(blob).reshape(-1, states)


def _own_cells(row, states: tuple | None) -> np.ndarray:
    return _array(row.cells, row.states)


def _computed(values: Callable[..., np.ndarray], metric: str) -> Callable:
    """A block's cells from its vectors and those of the pair's states."""

    def decode(row, states: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        j, right = states
        found = values(similarities(_array(row.cells, right.shape[1]), right, metric), np.asarray(row.place)[:, None], j[None, :], *row.own)
        if len(j) == row.states:
            return found
        out = np.full((len(found), row.states, *found.shape[2:]), -np.inf)
        out[:, j] = found
        return out

    return decode


def opened(batches: Iterator[pd.DataFrame], decode: Callable) -> Iterator[tuple]:
    """(row, cells) of blocks. The vectors of a pair's states, if it has any, come before its blocks."""
    key, held, states = None, [], None
    for batch in batches:
        for row in batch.itertuples(index=False):
            if (row.pair, row.part) != key:
                key, held, states = (row.pair, row.part), [], None
            if row.side == 0:
                held.append((np.asarray(row.place), np.frombuffer(row.cells).reshape(len(row.place), -1)))
                continue
            if held:
                held.sort(key=lambda x: x[0][0])
                states, held = tuple(np.concatenate(x) for x in zip(*held)), []
            yield row, decode(row, states)


class _Blocks:
    """The cells of all pairs, or the vectors that they are made of, written once in blocks of positions."""

    name, n = "hmm", 1

    def __init__(self, spark: SparkSession, cells: DataFrame | Products, on: list[str], block: int):
        # A row may be a whole block: workers get few bytes of them at a time, unless the session says otherwise.
        if spark.conf.get(_BATCH_BYTES, None) is None:
            spark.conf.set(_BATCH_BYTES, "4m")
        self.on, self.rounds, self.vectors = on, Rounds(spark, self.name), isinstance(cells, Products)
        if self.vectors:
            self.decode = _computed(cells.values, cells.metric)
            self._pack_vectors(cells, block)
        else:
            self.decode = _own_cells
            self._pack_cells(cells, block)

    def _save_pairs(self, sizes: DataFrame) -> DataFrame:
        """``on``, states, least (the first block) of all pairs, numbered."""
        return self.rounds.save(sizes.withColumn("pair", F.monotonically_increasing_id()), "pairs")

    def _features(self, cells: DataFrame) -> DataFrame:
        """The allowed cells with their value, or values, as ``f``."""
        known = cells.select(*self.on, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("value").cast("double").alias("f"))
        return known.where("i >= 0 and j >= 0 and f > double('-infinity') and f < double('infinity')")

    def _pack_cells(self, cells: DataFrame, block: int) -> None:
        known, on, n = self._features(cells), self.on, self.n
        self.pairs = self._save_pairs(known.groupBy(*on).agg((F.max("j") + 1).cast("int").alias("states"), F.floor(F.min("i") / block).alias("least")))
        own = known.alias("c").join(self.pairs.alias("p"), [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in on] or F.lit(True))
        own = own.select("pair", "states", "least", F.floor(F.col("i") / block).alias("block"), "i", "j", "f")

        def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            place = np.unique(pdf["i"])
            states, least = int(pdf["states"].iloc[0]), pdf["least"].iloc[0]
            out = np.full((len(place), states, n), -np.inf)
            np.maximum.at(out, (np.searchsorted(place, pdf["i"]), pdf["j"].to_numpy()), np.stack(pdf["f"].to_numpy()).reshape(-1, n))
            return pd.DataFrame([(key[0], 0, 1, key[1], key[1] == least, states, place, out.tobytes(), [])], columns=_NAMES)

        self.table = self.rounds.save(own.groupBy("pair", "block").applyInPandas(pack, _BLOCKS), "blocks")

    def _pack_vectors(self, cells: Products, block: int) -> None:
        on = self.on
        a, b = cells.side(cells.a, on, "place", *cells.own), cells.side(cells.b, on, "place")
        own = F.array(*[F.col(c).cast("double") for c in cells.own]).cast("array<double>")
        mine = a.groupBy(*on).agg(F.floor(F.min("place") / block).alias("least"))
        self.pairs = self._save_pairs(mine.join(b.groupBy(*on).agg((F.max("place") + 1).cast("int").alias("states")), on))
        keys = self.pairs.select(*on, "pair", "states", "least")
        left = a.select(*on, "place", "v", own.alias("own"), F.lit(1).alias("side"), F.floor(F.col("place") / block).alias("block"))
        right = b.select(*on, "place", "v", F.lit(None).cast("array<double>").alias("own"), F.lit(0).alias("side"), F.floor(F.col("place") / CHUNK).alias("block"))
        rows = left.unionByName(right).join(keys, on)

        def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("place")
            place, one = pdf["place"].to_numpy(), pdf.iloc[0]
            if (np.diff(place) == 0).any():
                raise ValueError("a pair's positions must be distinct")
            return pd.DataFrame([(key[0], 0, key[1], key[2], key[2] == one["least"], one["states"], place, np.stack(pdf["v"].to_numpy()).tobytes(), one["own"])], columns=_NAMES)

        self.table = self.rounds.save(rows.groupBy("pair", "side", "block").applyInPandas(pack, _BLOCKS), "vectors")

    def carried(self, moves: np.ndarray, add: np.ufunc, ups: list[bool]) -> list[DataFrame]:
        """pair, block and, for ``ups``, before: the vector before each block, or after: the one behind it. A task streams the blocks of a pair one way."""
        decode = self.decode

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last = x = None
            for row, cells in opened(batches, decode):
                if (row.pair, row.up) != last:
                    last, x = (row.pair, row.up), np.zeros(row.states)
                yield pd.DataFrame({"pair": [row.pair], "block": [row.block], "up": [row.up], "x": [x.tobytes()]})
                x = forth(x, cells, row.first, moves, add) if row.up else back(x, cells, moves, add)

        # Much is computed from few bytes, so tasks are dealt by number: Spark would join what looks small.
        tasks = min(max(8 * len(ups) * self.pairs.count(), 1), 2000)
        ways = F.explode(F.array(*map(F.lit, ups))).alias("up")
        sent = self.table.select("*", ways).withColumn("part", F.col("up").cast("long")).repartition(tasks, "pair", "up")
        sent = sent.sortWithinPartitions("pair", "up", "side", F.when(F.col("up"), F.col("block")).otherwise(-F.col("block")))
        found = self.rounds.save(sent.mapInPandas(run, "pair long, block long, up boolean, x binary"), "carried")
        return [found.where(F.col("up") == up).select("pair", "block", F.col("x").alias("before" if up else "after")) for up in ups]

    def whole(self, *borders: DataFrame) -> DataFrame:
        """Blocks with their borders (tables of pair, block and more), each after the vectors that its cells are made of."""
        part = F.floor(F.col("block") / PART)
        blocks = self.table.where("side = 1").withColumn("part", part)
        parts = blocks.select("pair", "part").distinct()
        for x in borders:
            blocks = blocks.join(x, ["pair", "block"])
        if not self.vectors:
            return blocks
        states = self.table.where("side = 0").drop("part").join(parts, "pair")
        sent = blocks.unionByName(states, allowMissingColumns=True).repartition(min(max(4 * parts.count(), 1), 4000), "pair", "part")
        return sent.sortWithinPartitions("pair", "part", "side", "block")

    def named(self, found: DataFrame, *columns: str) -> DataFrame:
        """``found`` with the pair's own keys."""
        return found.join(self.pairs, "pair").select(*self.on, *columns)


def best_path(spark: SparkSession, cells: DataFrame | Products, on: list[str], moves: list[float], block: int = BLOCK) -> DataFrame:
    """``on``, i, j, total: the likeliest state j of each position i, together (Viterbi), and the log score of that path.

    ``cells``: ``on``, i, j, value, or ``Products``; i and j from 0 on. A cell without a row, or with a null or no finite value, is not allowed; of repeated cells the greatest
    counts. The positions of a pair are those i that have a cell, in order; its states go up to its greatest j. Of equal ways the one whose later states are
    lowest is taken. A pair without any allowed path has no rows, and no cells give no rows. Other columns are not read. A task holds one block: ``block``
    positions by all states, and of ``Products`` the vectors of all states of a pair. Vectors are carried over a pair in one task.
    """
    steps = _moves(moves)
    own = _Blocks(spark, cells, on, block)
    decode = own.decode
    (before,) = own.carried(steps, np.maximum, [True])

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, cells in opened(batches, decode):
            score, came = best_steps(np.frombuffer(row.before), cells, row.first, steps)
            start = np.arange(row.states)
            for step in came[::-1]:  # the state before the block for each state at its end
                start = step[np.clip(start, 0, row.states - 1)]
            end = int(score.argmax())
            best = end if score[end] > -np.inf else -1
            yield pd.DataFrame({"pair": [row.pair], "block": [row.block], "best": [best], "total": [float(score[end])], "start": [start.astype(np.int64).tobytes()]})

    found = own.rounds.save(own.whole(before).mapInPandas(tables, "pair long, block long, best long, total double, start binary"), "starts")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, at, whole = None, -1, 0.0
        for batch in batches:
            out = []
            for pair, best, total, start in zip(batch["pair"], batch["best"], batch["total"], batch["start"]):
                if pair != last:
                    last, at, whole = pair, best, total
                out.append((at, whole))
                at = int(np.frombuffer(start, np.int64)[at]) if at >= 0 else at
            yield batch[["pair", "block"]].assign(end=[o[0] for o in out], total=[o[1] for o in out])

    sent = found.repartition("pair").sortWithinPartitions("pair", F.desc("block"))
    closed = own.rounds.save(sent.mapInPandas(ends, "pair long, block long, end long, total double").where("end >= 0"), "ends")

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, cells in opened(batches, decode):
            _, came = best_steps(np.frombuffer(row.before), cells, row.first, steps)
            at, out = int(row.end), []
            for step in came[::-1]:
                out.append(at)
                at = step[at]
            yield pd.DataFrame({"pair": row.pair, "i": row.place, "j": out[::-1], "total": row.total})

    return own.named(own.whole(before, closed).mapInPandas(paths, "pair long, i long, j long, total double"), "i", "j", "total")


def _between(own: _Blocks, moves: np.ndarray) -> DataFrame:
    return own.whole(*own.carried(moves, np.logaddexp, [True, False]))


def _each(batches: Iterator[pd.DataFrame], decode: Callable, moves: np.ndarray):
    for row, cells in opened(batches, decode):
        yield row, marginals(np.frombuffer(row.before), np.frombuffer(row.after), cells, row.first, moves)


def posteriors(spark: SparkSession, cells: DataFrame | Products, on: list[str], moves: list[float], least: float = 0.01, block: int = BLOCK) -> DataFrame:
    """``on``, i, j, posterior, log_likelihood of the cells whose probability, over all paths, is ``least`` or more (forward-backward).

    Cells, bounds and cases are those of ``best_path``.
    """
    steps = _moves(moves)
    own = _Blocks(spark, cells, on, block)
    decode = own.decode

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, (total, found, _) in _each(batches, decode, steps):
            t, j = np.nonzero((found >= least) & (found > 0))
            yield pd.DataFrame({"pair": row.pair, "i": np.asarray(row.place)[t], "j": j, "posterior": found[t, j], "log_likelihood": total})

    found = _between(own, steps).mapInPandas(run, "pair long, i long, j long, posterior double, log_likelihood double")
    return own.named(found, "i", "j", "posterior", "log_likelihood")


def fit_moves(spark: SparkSession, cells: DataFrame | Products, on: list[str], moves: list[float], rounds: int = 5, block: int = BLOCK) -> tuple[list[float], list[float]]:
    """(log probabilities of jumps after ``rounds`` of expectation maximisation, log likelihood of all pairs before each round).

    The likelihood never falls. A round's expected jumps are summed over all blocks of all pairs; 2 * J + 1 sums reach the driver. Pairs without an
    allowed path count for nothing. Where no jump is expected at all, moves stay as they are. Cells and cases are those of ``best_path``.
    """
    steps, own, likelihoods = _moves(moves), _Blocks(spark, cells, on, block), []
    decode = own.decode

    for _ in range(rounds):

        def run(batches: Iterator[pd.DataFrame], steps: np.ndarray = steps) -> Iterator[pd.DataFrame]:
            for row, (total, _, counts) in _each(batches, decode, steps):
                own_total = total if row.first and total > -np.inf else 0.0
                yield pd.DataFrame({"jump": [-1, *range(len(counts))], "n": [own_total, *counts]})

        sums = dict(_between(own, steps).mapInPandas(run, "jump int, n double").groupBy("jump").agg(F.sum("n")).collect())
        likelihoods.append(sums.pop(-1, 0.0))
        counts = np.array([sums.get(k, 0.0) for k in range(len(steps))])
        if counts.sum() > 0:
            with np.errstate(divide="ignore"):
                steps = np.log(counts / counts.sum())
    return steps.tolist(), likelihoods
