import random

import pytest
from pyspark.sql import functions as F

from cueline.operators import timeline

KIND = "film string, t long, k long"


def rows(seed, n):
    rng = random.Random(seed)
    # One film has most rows; some have none of a kind, and one has no name.
    return [(rng.choice(["hot"] * 20 + ["a", "b", None]), rng.choice([None, *range(40)]), i) for i in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame([(*r, "x") for r in rows(1, 120)], KIND + ", _n string"), spark.createDataFrame([r for r in rows(2, 60) if r[0] != "a"], KIND)


@pytest.mark.parametrize("how", timeline.HOWS)
def test_refs_are_carried_over_ranges(tables, how):
    probes, refs = tables
    found = [sorted(map(tuple, timeline.as_of(probes, refs, ["film"], "t", "t", how, "k", parts=p).collect()), key=str) for p in (None, 7, 50)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 120


def test_one_timeline_without_keys(spark, tables):
    probes, refs = tables
    probes = probes.dropna()
    known = sorted((r["t"], r["k"]) for r in refs.dropna(subset=["t"]).collect())
    for p, ref in timeline.as_of(probes, refs.dropna(subset=["t"]), [], "t", "t", "lt", "k", parts=9).select("t", "ref").collect():
        before = [x for x in known if x[0] < p]
        assert (ref and (ref["t"], ref["k"])) == (before[-1] if before else None)
    empty = refs.where("false")
    assert timeline.as_of(probes, empty, [], "t", "t", parts=4).where("ref is null").count() == probes.count()
    assert timeline.as_of(empty, refs, [], "t", "t", parts=4).count() == 0


def test_positions_nearest_between_and_slices(tables):
    probes, refs = tables
    same = lambda f: sorted(map(tuple, f(None).collect()), key=str) == sorted(map(tuple, f(6).collect()), key=str)
    assert same(lambda p: timeline.with_position(probes, ["film"], ["t", "k"], p).withColumn("pos", F.col("pos").cast("long")))
    assert same(lambda p: timeline.slice_positions(probes, ["film"], ["t", "k"], -9, -2, p).withColumn("pos", F.col("pos").cast("long")))
    assert same(lambda p: timeline.nearest(probes, refs, ["film"], "t", "t", "k", parts=p))
    assert same(lambda p: timeline.between(probes.withColumn("u", F.col("t") + 5), refs, ["film"], "t", "u", "t", ["k"], p).drop("_n"))


def test_ranges_of_one_hot_timeline_are_even(spark):
    table = spark.range(20_000).select(F.lit("hot").alias("film"), F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("t"))
    sizes = [r["count"] for r in timeline._ranges(table, ["film", "t"], 16).groupBy("_cueline_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
