"""Global order, running sums and next rows without a one-task window."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.scratch import Scratch

PART, LOCAL = "_part", "_local"


def running_total(scratch: Scratch, df: DataFrame, keys: list, value: str, out: str = "before") -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows sorted before the row by ``keys``.

    A prefix scan. Rows are range-partitioned by ``keys`` (which should end in a unique
    column, so that no key is too large for one partition) and sorted; each task writes its
    local exclusive sum; the totals, one row a partition, are summed and joined back. The
    scanned table is written once, since a range partitioning may differ when it is recomputed;
    ``scratch.drop`` of the result deletes it.

    ``keys`` may be names or Column expressions; ``value`` is a long or double column without
    nulls. Columns named ``_part`` or ``_local`` are replaced.
    """
    kind = df.schema[value].dataType
    dtype = np.float64 if isinstance(kind, T.DoubleType) else np.int64
    fields = [f for f in df.schema.fields if f.name not in (PART, LOCAL, out)]
    schema = T.StructType([*fields, T.StructField(PART, T.IntegerType()), T.StructField(LOCAL, kind)])
    names = [f.name for f in fields]

    def scan(batches):
        part, total = TaskContext.get().partitionId(), dtype(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(dtype)
            upto = np.cumsum(x) + total
            local = upto - x
            total = upto[-1]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.full(len(x), part, np.int32)), pa.array(local)], names=[*names, PART, LOCAL]
            )

    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    saved = scratch.save(ordered.mapInArrow(scan, schema), "scan")
    totals = saved.groupBy(PART).agg(F.sum(value).alias("_sum"))
    upto = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row for each partition: its number is a setting, not a function of a key.
    offsets = totals.select(PART, (F.sum("_sum").over(upto) - F.col("_sum")).alias("_offset"))
    joined = saved.join(F.broadcast(offsets), PART)
    summed = joined.withColumn(out, F.col("_offset") + F.col(LOCAL)).drop(PART, LOCAL, "_offset")
    summed.cueline_path = saved.cueline_path
    return summed


def with_follower(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows in ``parts`` ranges of the long column ``key``, each with the first rows of the next range.

    Adds ``_part`` and ``_ahead`` (true for the copies from the next range; the last range gets
    those of the first). Within a ``_part``, rows sorted by ``_ahead`` and ``key`` give every own
    row its successor in the whole table. Null keys sort first. The split points are quantiles of
    ``key`` and the first keys are minima: one number each for every range, whatever the input.
    """
    least = -(2**63)
    ids = df.select(F.coalesce(F.col(key), F.lit(least)).alias("k"))
    shares = [i / parts for i in range(1, parts)]
    found = ids.approxQuantile("k", shares, 0.1 / parts) if shares else []
    cuts = np.array(sorted({int(x) for x in found}), np.int64)

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="right").astype(np.int32))

    firsts = ids.groupBy(range_of("k").alias("p")).agg(F.min("k").alias("k")).collect()
    order = sorted((r["p"], r["k"]) for r in firsts)
    follows = {k: order[i - 1][0] for i, (_, k) in enumerate(order)}

    @F.pandas_udf("array<int>")
    def ranges(k: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, k.to_numpy(), side="right")
        return pd.Series([[int(p)] if x not in follows else [int(p), follows[x]] for p, x in zip(own, k)])

    both = F.posexplode(ranges(F.coalesce(F.col(key), F.lit(least)))).alias("_ahead", PART)
    return df.select("*", both).withColumn("_ahead", F.col("_ahead") > 0)
