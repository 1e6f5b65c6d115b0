"""Mixing sources to target shares of words by entropy balancing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.ordering import running_total
from cueline.llm.scratch import ROW, Scratch

WEIGHTS = (3.0, 1.0, 2.0)
#: Parts of a copy in which rates are added up.
UNIT = 1_000_000


@F.pandas_udf(T.LongType())
def count_words(text: pd.Series) -> pd.Series:
    """Runs of bytes that are no ASCII white space; 0 for null."""
    return pd.Series([0 if x is None else len(x.encode().split()) for x in text], dtype="int64")


def source_targets(scratch: Scratch, sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target for each source of ``sizes`` (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes by weight.
    A target stops at ``most`` times its source's size and the excess goes to the others by weight, until none
    is above. The level at which this ends is found from running sums of the sources ordered by the size that a
    unit of weight gets before they are full. Sources without words get 0.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # A byte-wise order of UTF-8 is the order of code points; null last.
    ranked = running_total(
        scratch, total.withColumn("one", F.lit(1).cast("long")), [F.col("source").isNull(), F.col("source")], "one", "rank"
    )
    turn = F.array(*map(F.lit, weights))
    ranked = ranked.select("source", "source_size", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"))
    ranked = ranked.withColumn("top", most * F.col("source_size").cast("double")).withColumn("full_at", F.col("top") / F.col("weight"))
    ranked = scratch.save(ranked, "sources")
    goal, weight = ranked.agg(share * F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    goal = min(goal, ranked.agg(F.coalesce(F.sum("top"), F.lit(0.0))).first()[0])
    # With the sources up to this one full, the others share the rest at this level; the first level below full_at holds.
    order = [F.col("full_at"), F.col("source").isNull(), F.col("source")]
    tops = running_total(scratch, ranked, order, "top", "tops")
    both = running_total(scratch, tops, order, "weight", "weights")
    level = (F.lit(goal) - F.col("tops")) / F.greatest(F.lit(weight) - F.col("weights"), F.lit(1e-300))
    held = both.withColumn("level", level).where(F.col("level") <= F.col("full_at")).agg(F.min_by("level", "full_at")).first()[0]
    reached = F.col("weight") * F.lit(held) if held is not None else F.col("top")
    return ranked.select("source", "source_size", F.least("top", reached).alias("target"))


def balance(scratch: Scratch, cells: DataFrame, targets: DataFrame, most: float = 2.0, tolerance: float = 1e-10, rounds: int = 60) -> DataFrame:
    """source, tilt, full for each source of ``targets`` (source, source_size, target): the multipliers of entropy balancing.

    The rates r of documents with sizes x minimise the sum of r log r - r over all documents, from a rate of 1 each, while the x * r of each
    source add up to its target and no rate is above ``most``. The dual is convex, with one multiplier a source, and the rates are exponential
    tilts, r = min(most, exp(tilt * x)). A Newton step needs, over all documents of a source, the sum of x * r
    (the gradient) and of x * x * r where r is below ``most`` (the Hessian). ``cells`` (source, size, n) are the documents with equal sizes
    counted, which have equal rates; sums are decimal, so that reruns agree. A step that leaves the bracket in which the solution lies is replaced by its middle.
    A source whose target is ``most`` times its size is full: all its rates are ``most``. Without words, or with a target of 0, a source has no tilt.
    """
    size, target = F.col("source_size").cast("double"), F.col("target")
    share = F.try_divide(target, size)
    state = targets.select(
        F.col("source").alias("s"), "source_size", "target",
        ((size > 0) & (target >= most * size * (1 - 1e-12))).alias("full"),
        F.lit(0.0).alias("tilt"),
        F.when(share > 0, F.least(F.log(share), F.lit(0.0))).alias("low"),
        F.lit(math.log(most)).alias("high"),
        F.lit(False).alias("done"),
    )
    state = state.withColumn("done", F.col("full") | F.col("low").isNull())
    state = scratch.save(state, "dual")
    for _ in range(rounds):
        if state.where("not done").isEmpty():
            break
        x, rate = F.col("size").cast("double"), F.exp(F.col("tilt") * F.col("size"))
        open_ = state.where("not done").select("s", "tilt")
        sums = cells.join(open_, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
            F.sum(F.col("n") * F.col("size") * F.least(rate, F.lit(most)).cast("decimal(14,12)")).cast("double").alias("reached"),
            F.sum(F.when(rate < most, F.col("n") * x * x * rate).otherwise(0.0).cast("decimal(38,0)")).cast("double").alias("slope"),
        )
        sums = sums.select(F.col("s").alias("_s"), "reached", "slope")
        joined = state.join(sums, F.col("s").eqNullSafe(F.col("_s")), "left")
        off = F.col("reached") - F.col("target")
        low, high = F.when(off < 0, F.col("tilt")).otherwise(F.col("low")), F.when(off >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - off / F.greatest("slope", F.lit(1e-300))
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        step = F.when(inside, newton).otherwise((low + high) / 2)
        settled = F.col("done") | (F.abs(off) <= tolerance * F.col("target")) | (high - low <= 1e-15)
        joined = joined.select(
            "s", "source_size", "target", "full", F.when(settled, F.col("tilt")).otherwise(step).alias("tilt"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"), settled.alias("done"),
        )
        state = scratch.save(joined, "dual")
    return state.select(F.col("s").alias("source"), "source_size", "target", "full", "tilt")


def _repairs(scratch: Scratch, cells: DataFrame, most: int, repairs: int) -> DataFrame:
    """row, change: documents that get or lose one copy, so that their source comes nearer to its target.

    ``cells`` (source, size, copies, target, n, who) are the documents with equal sizes and copies, one of which may change. In each round each source
    changes the one that brings it nearest, as long as that helps.
    """
    gaps = cells.groupBy("source").agg((F.first("target") - F.sum(F.col("n") * F.col("copies") * F.col("size"))).alias("gap"))
    gaps = scratch.save(gaps.select(F.col("source").alias("s"), "gap"), "gaps")
    options = cells.where("size > 0").withColumn("change", F.explode(F.array(F.lit(1), F.lit(-1))))
    options = options.where(F.col("copies") + F.col("change") <= most).where(F.col("copies") + F.col("change") >= 0)
    found = None
    for _ in range(repairs):
        after = F.abs(F.col("gap") - F.col("change") * F.col("size"))
        able = options.join(gaps, F.col("source").eqNullSafe(F.col("s"))).where(after < F.abs("gap"))
        best = able.groupBy("source").agg(F.min(F.struct(after.alias("after"), "who", "size", "change")).alias("b"))
        best = scratch.save(best.select("source", "b.who.row", "b.who", "b.size", "b.change"), "repair")
        if best.isEmpty():
            break
        found = best if found is None else found.unionByName(best)
        options = options.join(best.select("row"), F.col("who.row") == F.col("row"), "left_anti")
        moved = best.select(F.col("source").alias("_s"), (F.col("change") * F.col("size")).alias("moved"))
        gaps = gaps.join(moved, F.col("s").eqNullSafe(F.col("_s")), "left").select("s", (F.col("gap") - F.coalesce("moved", F.lit(0))).alias("gap"))
        gaps = scratch.save(gaps, "gaps")
    return found.select("row", "change") if found is not None else None


def mix(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2, repairs: int = 6, row: str | None = None) -> DataFrame:
    """doc_id, row, source, size, source_size, target, rate, copies, taken for each row of ``docs`` (doc_id, text, source).

    Rates are those of ``balance``; they depend on source and size. They are rounded into copies: with the documents of a source in the order of their
    sizes, a document gets the whole numbers that the running sum of rates passes, so neighbours share what is due and no document gets more
    than its rate rounded up. What a source then lacks or exceeds is repaired by one copy more or less of at most ``repairs`` documents a
    source, found among the distinct sizes and applied at once. Copies never exceed ``most``.
    Null text: size 0. Null source: a source of its own. Ties in size are ordered by doc_id and a hash of the
    text, so that reruns agree; equal rows are the same to the result. Documents of size 0 bear on no target: rate 1, one copy.
    An empty table gives no rows. Other columns are not read. ``row`` names a column of distinct longs that is given back as row; else rows are numbered here.
    """
    scratch = Scratch(spark, "mixing")
    number = F.col(row) if row else F.monotonically_increasing_id()
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", count_words("text").alias("size"), F.xxhash64("text").alias("tie"), number.alias("row"))
    sized = scratch.save(sized, "sizes")
    targets = source_targets(scratch, sized, weights, share, most)
    cells = scratch.save(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    tilts = balance(scratch, cells, targets, most).withColumnRenamed("source", "s")
    tilt = F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.exp(F.col("tilt") * F.col("size")), F.lit(float(most))))
    nothing = (F.col("target") <= 0) & (F.col("size") > 0)
    rated = cells.join(tilts, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", F.round(F.when(nothing, 0.0).when(F.col("size") == 0, 1.0).otherwise(tilt), 9))
    # Whole millionths, so that running sums don't depend on how the rows are dealt.
    rated = rated.select("s", F.col("size").alias("x"), "source_size", "target", "rate", F.round(F.col("rate") * UNIT).cast("long").alias("due"))
    rated = scratch.save(rated, "rates")
    known = sized.join(rated, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("x"))).drop("s", "x")
    # Ordered by source: each source's documents follow each other by size, and the sum in the source is a difference.
    order = [F.col("source"), F.col("size").desc(), F.col("doc_id"), F.col("tie"), F.col("row")]
    placed = running_total(scratch, scratch.save(known, "known"), order, "due", "before")
    first = placed.groupBy(F.col("source").alias("s")).agg(F.min("before").alias("first"))
    placed = placed.join(first, F.col("source").eqNullSafe(F.col("s")))
    before = F.col("before") - F.col("first") + UNIT // 2
    copies = F.floor((before + F.col("due")) / UNIT) - F.floor(before / UNIT)
    chosen = placed.select("doc_id", "row", "source", "size", "tie", "source_size", "target", "rate", copies.cast("int").alias("copies"))
    chosen = scratch.save(chosen, "chosen")
    scratch.keep_only(chosen)
    equal = chosen.groupBy("source", "size", "copies", "target").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tie", "row")).alias("who"))
    changes = _repairs(scratch, scratch.save(equal, "equal"), most, repairs)
    if changes is not None:
        chosen = chosen.join(changes, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    return chosen.select("doc_id", "row", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Each row of ``docs`` as many times as the mix takes it. Rows are told apart by their numbers, so ids may be null or repeated, and other columns may have any names."""
    numbered = Scratch(spark, "mixed").number(docs)
    copies = mix(spark, numbered, row=ROW, **options).where("copies > 0").select(F.col("row").alias(ROW), "copies")
    whole = numbered.select(ROW, F.struct(*docs.columns).alias("_whole"))
    return whole.join(copies, ROW).select("_whole", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_whole.*")
