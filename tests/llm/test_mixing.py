import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cueline.llm import mixing


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    goal, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = goal / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            goal -= target[s]
            free.discard(s)
    return target | {s: weight[s] * level for s in free}


def tilt_by_hand(own, target):
    """The multiplier at which the bounded tilts reach the target, by bisection."""
    low, high = -50.0, math.log(2)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(x * math.exp(min(mid * x, math.log(2))) for x in own) < target:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def test_mix_reaches_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 200)), rng.choice(["a", "b", "Z", "é", None])) for i in range(900)]
    rows += [(5, "w w", "only"), (None, None, "none"), (None, "x y z", "b"), (None, "x y z", "b"), (7, "w " * 3_000, "a")]
    docs = spark.createDataFrame([(*r, -1, "x") for r in rows], "doc_id long, text string, source string, copies long, size string")
    first, again = (sorted(mixing.mix(spark, docs.repartition(k)).select("doc_id", "source", "size", "source_size", "target", "rate", "taken").collect(), key=str) for k in (3, 7))
    assert first == again and len(first) == len(rows)
    sizes = defaultdict(list)
    for _, t, s in rows:
        sizes[s].append(len((t or "").split()))
    target = targets_by_hand({s: sum(x) for s, x in sizes.items()})
    taken, tilts = defaultdict(int), {s: tilt_by_hand(x, target[s]) for s, x in sizes.items() if 0 < target[s] < 2 * sum(x)}
    assert len(tilts) >= 2
    for r in first:
        s = r["source"]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == sum(sizes[s])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"]
        if s in tilts:
            assert r["rate"] == pytest.approx(math.exp(min(tilts[s] * r["size"], math.log(2))), rel=1e-6)
        elif r["size"]:
            assert r["rate"] == 2.0 and r["taken"] == 2 * r["size"]
        taken[s] += r["taken"]
    assert len({r["rate"] for r in first if r["source"] in tilts}) > 50
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(3, 0.002 * target[s]), s


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert mixing.mix(spark, docs.where("false")).count() == 0
    assert [(r["copies"], r["taken"]) for r in mixing.mix(spark, docs).collect()] == [(1, 0), (1, 0)]
    assert mixing.mixed_documents(spark, docs.withColumn("copies", F.lit(5)).withColumn("row", F.lit(1))).count() == 2
