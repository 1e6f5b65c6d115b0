"""Lookups on a timeline: as-of, nearest and between, for whole tables of probes or one time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.errors import DatasetError
from cueline.shared import Rounds

HOWS = ("lt", "le", "gt", "ge")


def _same(left: str, right: str, on: list[str]) -> Column:
    out = F.lit(True)
    for k in on:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def _ranges(table: DataFrame, order: list, parts: int) -> DataFrame:
    """``table``, written in ``parts`` ranges of ``order`` that ``_cueline_part`` numbers. Rows that are equal in ``order`` are in one range."""
    return Rounds(table.sparkSession, "ranges").save(table.repartitionByRange(parts, *order).withColumn("_cueline_part", F.spark_partition_id()), "ranges")


def _carry(ranged: DataFrame, by_range: DataFrame, on: list[str], value: str) -> DataFrame:
    """``ranged`` with ``value`` of its range in ``by_range`` (_cueline_part, ``on``, ``value``), which only a timeline that began in an earlier range has.

    Ranges are cut from tables in the order of ``on``, so that is one timeline for each range: there are no more rows to broadcast than ranges.
    """
    few = F.broadcast(by_range.where(F.col(value).isNotNull()))
    both = ranged.alias("l").join(few.alias("r"), _same("l", "r", ["_cueline_part", *on]), "left")
    return both.select("l.*", f"r.{value}")


def with_position(table: DataFrame, on: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``table`` with ``pos``, from 0, in each timeline ``on``.

    A timeline is one task's work, or with ``parts`` that of many: the table is cut into so many ranges of timeline and time, and a timeline's positions
    go on over the borders of ranges.
    """
    if not parts:
        return table.withColumn("pos", F.row_number().over(Window.partitionBy(*on).orderBy(*order)) - 1)
    ranged = _ranges(table, [*on, *order], parts)
    earlier = Window.partitionBy(*on).orderBy("_cueline_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_cueline_part", *on).agg(F.count("*").alias("_n")).withColumn("_cueline_before", F.sum("_n").over(earlier)).drop("_n")
    own = F.row_number().over(Window.partitionBy("_cueline_part", *on).orderBy(*order)) - 1
    return _carry(ranged.withColumn("pos", own), counts, on, "_cueline_before").withColumn("pos", F.col("pos") + F.coalesce("_cueline_before", F.lit(0))).drop("_cueline_part", "_cueline_before")


def slice_positions(table: DataFrame, on: list[str], order: list[str], start: int | None = None, stop: int | None = None, parts: int | None = None) -> DataFrame:
    """The rows from ``start`` to before ``stop`` of each timeline; negative positions count from its end. ``parts`` is that of ``with_position``."""
    table = with_position(table, on, order, parts)
    if parts:
        counts = table.groupBy(*on).agg(F.count("*").alias("_cueline_n"))
        table = table.alias("l").join(counts.alias("r"), _same("l", "r", on)).select("l.*", "_cueline_n")
    else:
        table = table.withColumn("_cueline_n", F.count("*").over(Window.partitionBy(*on)))
    low = F.lit(0) if start is None else F.lit(start) if start >= 0 else F.col("_cueline_n") + start
    high = F.col("_cueline_n") if stop is None else F.lit(stop) if stop >= 0 else F.col("_cueline_n") + stop
    return table.where((F.col("pos") >= low) & (F.col("pos") < high)).drop("_cueline_n")


def as_of(
    probes: DataFrame, refs: DataFrame, on: list[str], at: str, ts: str, how: str = "le", tie: str | None = None, name: str = "ref", parts: int | None = None
) -> DataFrame:
    """``probes`` with ``name``: the struct of the last row of ``refs`` before, or the first after, each probe's time.

    ``how`` is lt or le (the last with ``ts`` < or <= ``at``), gt or ge (the first with ``ts`` > or >= ``at``). Of refs at one
    time the last or first by ``tie`` counts. Null if there is none. Both tables are sorted once, together, by ``on`` and time;
    nothing is joined, so a timeline costs its length however many probes it has.

    A timeline is one task's work. With ``parts`` the rows are cut into so many ranges of timeline and time, written once, and the last ref of a
    timeline is carried over the borders of ranges: for timelines, or one, that are too long for a task.
    """
    if how not in HOWS:
        raise ValueError(f"how must be one of {HOWS}")
    tie_of = F.col(tie) if tie else F.lit(0)
    own = F.struct(*[F.col(c) for c in refs.columns])
    whole = F.struct(*[F.col(c) for c in probes.columns])
    none = lambda df, s: F.lit(None).cast(df.select(s.alias("s")).schema["s"].dataType)
    keys = [F.col(k) for k in on]
    first_ref = how in ("le", "ge")
    p = probes.select(*keys, F.col(at).alias("_t"), F.lit(1 if first_ref else 0).alias("_k"), F.lit(None).cast(refs.select(tie_of.alias("t")).schema["t"].dataType).alias("_o"), whole.alias("_p"), none(refs, own).alias("_r"))
    r = refs.select(*keys, F.col(ts).alias("_t"), F.lit(0 if first_ref else 1).alias("_k"), tie_of.alias("_o"), none(probes, whole).alias("_p"), own.alias("_r"))
    forward = how in ("gt", "ge")
    order = [F.col("_t").desc(), F.col("_k"), F.col("_o").desc()] if forward else [F.col("_t"), F.col("_k"), F.col("_o")]
    both = p.unionByName(r)
    if parts:
        both = _ranges(both, [*keys, *order], parts)
    w = Window.partitionBy(*(["_cueline_part"] if parts else []), *on).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_r", ignorenulls=True).over(w))
    if parts:
        place = F.when(F.col("_r").isNotNull(), F.struct("_t", "_o"))
        last = (F.min_by if forward else F.max_by)("_r", place)
        earlier = Window.partitionBy(*on).orderBy("_cueline_part").rowsBetween(Window.unboundedPreceding, -1)
        lasts = both.groupBy("_cueline_part", *on).agg(last.alias("_last")).withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
        found = _carry(found, lasts, on, "_carried").withColumn("_found", F.coalesce("_found", "_carried"))
    return found.where(F.col("_p").isNotNull()).select("_p.*", F.col("_found").alias(name))


def nearest(probes: DataFrame, refs: DataFrame, on: list[str], at: str, ts: str, tie: str | None = None, name: str = "ref", parts: int | None = None) -> DataFrame:
    """``probes`` with the row of ``refs`` nearest in time; the earlier one if two are as near. ``parts`` is that of ``as_of``."""
    both = as_of(as_of(probes, refs, on, at, ts, "lt", tie, "_before", parts), refs, on, at, ts, "ge", tie, "_after", parts)
    before, after = F.col(f"_before.{ts}"), F.col(f"_after.{ts}")
    later = before.isNull() | (after.isNotNull() & ((after - F.col(at)) < (F.col(at) - before)))
    return both.withColumn(name, F.when(later, F.col("_after")).otherwise(F.col("_before"))).drop("_before", "_after")


def between(probes: DataFrame, refs: DataFrame, on: list[str], start: str, end: str, ts: str, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """``probes`` with first_pos, last_pos and n: the rows of ``refs`` with start <= ts <= end (nulls and 0 if there are none). ``parts`` is that of ``as_of``."""
    refs = with_position(refs.select(*on, ts, *[c for c in order or [] if c not in (*on, ts)]), on, [ts, *(order or [])], parts).select(*on, ts, "pos")
    both = as_of(as_of(probes, refs, on, start, ts, "ge", "pos", "_a", parts), refs, on, end, ts, "le", "pos", "_b", parts)
    n = F.col("_b.pos") - F.col("_a.pos") + 1
    some = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (n > 0)
    return both.select(
        *probes.columns, F.when(some, F.col("_a.pos")).alias("first_pos"), F.when(some, F.col("_b.pos")).alias("last_pos"), F.when(some, n).otherwise(0).alias("n")
    )


class Timeline:
    """One timestamped table with scalar lookups, which raise DatasetError where nothing is found."""

    def __init__(self, table: DataFrame, ts: str = "timestamp_start"):
        self.table, self.ts = table, ts

    def __len__(self) -> int:
        return self.table.count()

    def _one(self, found: DataFrame, what: str):
        row = found.first()
        if row is None:
            raise DatasetError(f"no entry {what}")
        return row

    def _edge(self, condition: Column, last: bool, what: str):
        order = F.col(self.ts).desc() if last else F.col(self.ts)
        return self._one(self.table.where(condition).orderBy(order).limit(1), what)

    def find_lt(self, t: float):
        return self._edge(F.col(self.ts) < t, True, f"before {t}")

    def find_le(self, t: float):
        return self._edge(F.col(self.ts) <= t, True, f"at or before {t}")

    def find_gt(self, t: float):
        return self._edge(F.col(self.ts) > t, False, f"after {t}")

    def find_ge(self, t: float):
        return self._edge(F.col(self.ts) >= t, False, f"at or after {t}")

    def find_nearest(self, t: float):
        gap = F.abs(F.col(self.ts) - F.lit(t))
        return self._one(self.table.orderBy(gap, self.ts).limit(1), f"near {t}")

    def find_between(self, start: float, end: float) -> DataFrame:
        if start > end:
            raise ValueError("start is after end")
        return self.table.where(F.col(self.ts).between(start, end)).orderBy(self.ts)

    def __getitem__(self, key):
        if isinstance(key, slice):
            parts = int(self.table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            return slice_positions(self.table, [], [self.ts], key.start, key.stop, parts)
        return self._one(self[key : key + 1 if key != -1 else None], f"at {key}")

    def __iter__(self):
        for row in self.table.orderBy(self.ts).toLocalIterator():
            yield row[self.ts], row
