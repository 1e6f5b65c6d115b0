"""Colinear chains of anchors with priced gaps.

An anchor (i, j, weight) may follow another that is before it on both axes. A chain is worth its weights, less
``gap`` for each position that it skips on either axis. Chains that share no anchor are taken from one pass: an anchor
belongs to the best chain that goes through it, so each moved scene comes out as a chain of its own.

The plane of a pair of sequences is cut into tiles of ``tile`` x ``tile`` positions. Tiles of one anti-diagonal don't depend on
each other: they are one round of tasks, for all pairs at once. A tile needs of the finished tiles of its row and column only the anchors that were the best so
far, by rows or by columns (some for each position, however dense a tile is), and the best one below both; a second sweep brings the ends of chains back to their anchors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueline.shared import Rounds

#: Positions of a tile on each axis: a task may hold as many anchors as a tile has cells.
TILE = 1536

_FOUND = "i long, j long, weight double, score double, pred_i long, pred_j long, value double, by_row boolean, by_column boolean"


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """The place of each entry in the order of ``keys``, the first of which weighs most."""
    out = np.empty(len(keys[0]), np.int64)
    out[np.lexsort(keys[::-1])] = np.arange(len(out))
    return out


def _bests(value: np.ndarray, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which entries are greater, by value, then i, then j, than all before them in ``order``."""
    ranks = _ranks(value, i, j)[order]
    out = np.empty(len(order), bool)
    out[order] = ranks == np.maximum.accumulate(ranks)
    return out


def chain_tile(i: np.ndarray, j: np.ndarray, weight: np.ndarray, gap: float, row: tuple, column: tuple, below: tuple) -> tuple[np.ndarray, ...]:
    """(score, pred_i, pred_j, value) of a tile's anchors, which are in the order of i, then j; pred is -1 where a chain begins.

    ``row``, ``column``: (value, i, j) of finished anchors of tiles with the same rows and lower columns, and the other way round;
    ``below``: of tiles lower in both. value is score + gap * (i + j), which orders predecessors; of equal ones
    the last by i, then j, is taken, and none where a chain had better begin.
    """
    columns = np.unique(np.concatenate((j, column[2])))
    # The best entry of columns before each one, and of all; the first is that of columns before the tile.
    best_v, best_i, best_j = np.full(len(columns) + 1, -np.inf), np.zeros(len(columns) + 1, np.int64), np.zeros(len(columns) + 1, np.int64)

    def greater(at: slice, v, k, c) -> np.ndarray:
        return (v > best_v[at]) | ((v == best_v[at]) & ((k > best_i[at]) | ((k == best_i[at]) & (c > best_j[at]))))

    def put(at: slice, v, k, c) -> None:
        new = greater(at, v, k, c)
        for best, x in ((best_v, v), (best_i, k), (best_j, c)):
            np.copyto(best[at], x, where=new)

    for v, k, c in zip(*below):
        put(slice(0, None), v, k, c)
    order = np.lexsort((column[1], column[2]))
    top = order[_bests(*column, order)[order]]
    for v, k, c in zip(*(x[top] for x in column)):
        put(slice(int(np.searchsorted(columns, c)) + 1, None), v, k, c)
    order = np.lexsort((row[2], row[1]))
    waiting = list(zip(*(x[order[_bests(*row, order)[order]]].tolist() for x in row)))
    ranks = np.searchsorted(columns, j)
    score, value, pred_i, pred_j = weight.copy(), np.empty(len(i)), np.full(len(i), -1), np.full(len(i), -1)
    cuts, at = np.flatnonzero(np.diff(i, prepend=i[0] - 1)), 0
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(i)]):
        while at < len(waiting) and waiting[at][1] < i[x]:
            put(slice(0, None), *waiting[at])
            at += 1
        r, places = ranks[x:y], i[x:y] + j[x:y]
        gain = best_v[r] - gap * (places - 2)
        own = gain > 0
        score[x:y][own] += gain[own]
        pred_i[x:y][own], pred_j[x:y][own] = best_i[r][own], best_j[r][own]
        value[x:y] = v = score[x:y] + gap * places
        most = np.maximum.accumulate(v)
        last = np.maximum.accumulate(np.where(v == most, np.arange(y - x), 0))
        spread = np.repeat(last, np.diff(r, append=len(columns)))
        put(slice(int(r[0]) + 1, None), v[spread], i[x], j[x:y][spread])
    return score, pred_i, pred_j, value


def owner_tile(i: np.ndarray, j: np.ndarray, score: np.ndarray, pred_i: np.ndarray, pred_j: np.ndarray, ends: tuple) -> tuple[tuple, tuple]:
    """((score, i, j) of the ends of a tile's anchors, (i, j, score, i, j): ends for predecessors in other tiles).

    Anchors are in the order of i, then j. ``ends``: (i, j, end's score, i, j) that later tiles send to its anchors. The best end has the greatest score, then the least
    i, then j.
    """
    all_ends = tuple(np.concatenate(x) for x in zip((score, i, j), ends[2:]))
    order = np.lexsort((all_ends[2], all_ends[1], -all_ends[0]))
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.arange(len(order))
    n, low = len(i), j.min()
    width = j.max() - low + 1
    keys = (i - i[0]) * width + (j - low)

    def places(k: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where anchors stand; -1: elsewhere."""
        inside = (k >= i[0]) & (c >= low) & (c < low + width)
        key = np.where(inside, (k - i[0]) * width + (c - low), 0)
        at = np.minimum(np.searchsorted(keys, key), n - 1)
        return np.where(inside & (keys[at] == key), at, -1)

    best, pred = ranks[:n].copy(), places(pred_i, pred_j)
    np.minimum.at(best, places(ends[0], ends[1]), ranks[n:])
    cuts = np.flatnonzero(np.diff(i, prepend=i[0] - 1)).tolist()
    for x, y in reversed(list(zip(cuts, [*cuts[1:], n]))):
        own = pred[x:y] >= 0
        np.minimum.at(best, pred[x:y][own], best[x:y][own])
    away = np.flatnonzero((pred < 0) & (pred_i >= 0))
    away = away[np.lexsort((best[away], pred_j[away], pred_i[away]))]
    new = (np.diff(pred_i[away], prepend=-1) != 0) | (np.diff(pred_j[away], prepend=-1) != 0)
    away = away[new]
    found = lambda own: tuple(x[order[own]] for x in all_ends)
    return found(best), (pred_i[away], pred_j[away], *found(best[away]))


#: What a row is to a tile.
_OWN, _ROW, _COLUMN, _BELOW = range(4)


def _forward(rounds: Rounds, tiles: DataFrame, on: list[str], keys: str, gap: float, steps: list[int]) -> list[DataFrame]:
    """The scored anchors of each round: one table an anti-diagonal, ascending. Of repeated anchors the heaviest counts."""
    done: list[DataFrame] = []
    bests: list[DataFrame] = []
    kind = f"{keys}, p long, q long, {_FOUND}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["kind"] == _OWN].sort_values(["i", "j", "weight"]).drop_duplicates(["i", "j"], keep="last")
        i, j, weight = (own[c].to_numpy() for c in ("i", "j", "weight"))
        entries = [tuple(pdf.loc[pdf["kind"] == k, c].to_numpy() for c in ("value", "i", "j")) for k in (_ROW, _COLUMN, _BELOW)]
        score, pred_i, pred_j, value = chain_tile(i, j, weight, gap, *entries)
        by_row, by_column = _bests(value, i, j, np.arange(len(i))), _bests(value, i, j, np.lexsort((i, j)))
        found = own[[*on, "p", "q", "i", "j", "weight"]].assign(score=score, pred_i=pred_i, pred_j=pred_j, value=value, by_row=by_row, by_column=by_column)
        return found[[x.split()[0].strip("`") for x in kind.split(", ")]]

    columns = [*on, "p", "q", "kind", "i", "j", "weight", "value"]
    for d in steps:
        mine = tiles.where(F.col("p") + F.col("q") == d)
        parts = mine.select(*on, "p", "q", F.lit(_OWN).alias("kind"), "i", "j", "weight", F.lit(0.0).alias("value"))
        if done:
            before = rounds.several(bests).withColumnsRenamed({"p": "_p", "q": "_q"})
            places = mine.select(*on, "p", "q").distinct()
            row = before.where("by_row").join(places.withColumn("_p", F.col("p")), [*on, "_p"]).where("q > _q")
            column = before.where("by_column").join(places.withColumn("_q", F.col("q")), [*on, "_q"]).where("p > _p")
            # Only each tile's best anchor can be the best below.
            peak = before.groupBy(*on, "_p", "_q").agg(F.max(F.struct("value", "i", "j")).alias("m"))
            low = peak.join(places, on).where("p > _p and q > _q").groupBy(*on, "p", "q").agg(F.max("m").alias("m")).select(*on, "p", "q", "m.*")
            for name, other in ((_ROW, row), (_COLUMN, column), (_BELOW, low)):
                parts = parts.unionByName(other.select(*on, "p", "q", F.lit(name).alias("kind"), "i", "j", F.lit(0.0).alias("weight"), "value"))
        done.append(rounds.save(parts.select(*columns).groupBy(*on, "p", "q").applyInPandas(run, kind), "scored"))
        if d != steps[-1]:
            bests.append(rounds.save(done[-1].where("by_row or by_column").select(*on, "p", "q", "i", "j", "value", "by_row", "by_column"), "bests"))
    return done


def _backward(rounds: Rounds, done: list[DataFrame], on: list[str], keys: str, tile: int) -> list[DataFrame]:
    """Anchors and their ends, ``lead`` where they are the first of their chain in a tile: the rounds in reverse, each sending ends to the tiles of predecessors."""
    kind = f"{keys}, p long, q long, sent boolean, lead boolean, i long, j long, weight double, score double, end_score double, end_i long, end_j long"
    names = [x.split()[0].strip("`") for x in kind.split(", ")]
    out: list[DataFrame] = []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, sent = pdf[~pdf["sent"]].sort_values(["i", "j"]), pdf[pdf["sent"]]
        i, j, weight, score, pred_i, pred_j = (own[c].to_numpy() for c in ("i", "j", "weight", "score", "pred_i", "pred_j"))
        mine, away = owner_tile(i, j, score, pred_i, pred_j, tuple(sent[c].to_numpy() for c in ("i", "j", "score", "pred_i", "pred_j")))
        ends = pd.DataFrame({"i": mine[1], "j": mine[2]})
        found = own[[*on, "p", "q", "i", "j", "weight", "score"]].assign(sent=False, lead=~ends.duplicated().to_numpy(), end_score=mine[0], end_i=mine[1], end_j=mine[2])
        other = pd.DataFrame({"p": away[0] // tile, "q": away[1] // tile, "sent": True, "lead": False, "i": away[0], "j": away[1], "weight": 0.0, "score": 0.0, "end_score": away[2], "end_i": away[3], "end_j": away[4]})
        for c in on:
            other[c] = pd.Series([own[c].iloc[0]] * len(other), dtype=own[c].dtype)
        return pd.concat([found[names], other[names]]) if len(other) else found[names]

    for table in reversed(done):
        parts = table.select(*on, "p", "q", F.lit(False).alias("sent"), "i", "j", "weight", "score", "pred_i", "pred_j")
        if out:
            places = table.select(*on, "p", "q").distinct()
            sent = rounds.several(out).where("sent").select(*on, "p", "q", "sent", "i", "j", "weight", F.col("end_score").alias("score"), F.col("end_i").alias("pred_i"), F.col("end_j").alias("pred_j"))
            parts = parts.unionByName(sent.join(places, [*on, "p", "q"], "left_semi"))
        out.append(rounds.save(parts.groupBy(*on, "p", "q").applyInPandas(run, kind), "ends"))
    return out


def chain_anchors(spark: SparkSession, anchors: DataFrame, on: list[str], gap: float = 0.0, least: float = 0.0, tile: int = TILE) -> DataFrame:
    """``on``, chain, pos, i, j, weight, score, chain_score: the anchors (``on``, i, j, weight) of all chains worth ``least`` or more.

    i and j are positions (longs from 0 on, such as line numbers). Chains are numbered from 1 in each pair of sequences by chain_score, best first,
    then by their last anchor; pos counts a chain's anchors from 1; score is what the best chain up to the anchor is worth. A chain that
    leaves another one's anchor is worth what it adds to it. Anchors with nulls, with weights that are no finite numbers or not above 0, are dropped; of
    anchors at one place the heaviest counts. No anchors: no rows.
    """
    keys = ", ".join(f"`{k}` {anchors.schema[k].dataType.simpleString()}" for k in on)
    rounds = Rounds(spark, "chains")
    weight = F.col("weight").cast("double")
    known = anchors.select(*on, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), weight.alias("weight"))
    known = known.dropna().where("weight > 0 and weight < double('infinity') and not isnan(weight)")
    tiles = rounds.save(known.withColumn("p", F.floor(F.col("i") / tile)).withColumn("q", F.floor(F.col("j") / tile)), "tiles")
    # One number for each anti-diagonal that has anchors: rounds are run one after the other.
    steps = sorted(r[0] for r in tiles.select(F.col("p") + F.col("q")).distinct().collect())
    if not steps:
        return spark.createDataFrame([], f"{keys}, chain long, pos long, i long, j long, weight double, score double, chain_score double")
    done = _forward(rounds, tiles, on, keys, gap, steps)
    scored = rounds.several(_backward(rounds, done, on, keys, tile)).where("not sent").select(*on, "i", "j", "weight", "score", "lead", "end_i", "end_j", "end_score")
    chain = [*on, "end_i", "end_j"]
    # What a chain adds: its end's score, less what its first anchor takes over from another chain.
    heads = scored.where("lead").groupBy(*chain).agg(F.min(F.struct("i", "j", "weight", "score")).alias("h"), F.max("end_score").alias("end_score"))
    heads = heads.select(*chain, (F.col("end_score") - (F.col("h.score") - F.col("h.weight"))).alias("chain_score")).where(F.col("chain_score") >= least)
    order = Window.partitionBy(*on).orderBy(F.desc("chain_score"), "end_i", "end_j")
    numbered = heads.withColumn("chain", F.row_number().over(order).cast("long"))
    # Chains are told apart by their ends, by which the rows are dealt already.
    pos = F.row_number().over(Window.partitionBy(*chain).orderBy("i")).cast("long")
    return scored.join(numbered, chain).withColumn("pos", pos).select(*on, "chain", "pos", "i", "j", "weight", "score", "chain_score")
