"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.scratch import Scratch


def components(scratch: Scratch, links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (long columns ``a``, ``b``): the smallest node it is joined to.

    Alternating star contraction: a large-star step hangs the larger neighbours of each node on the
    least node of its neighbourhood, a small-star step does so with the smaller ones. Both only rewire
    links, so there are never more of them than at first, and they end as stars. A node with very many
    links is only grouped for its minimum (with partial aggregation) and joined back, which adaptive
    execution can split. Each round is a written table; two sums show when nothing moves.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges, before = scratch.save(edges, "links"), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # Large star: each larger neighbour points to the least node around.
        large = both.join(least, "a").where("b > a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours point to the least of them.
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(b.alias("a"), F.col("m")))).alias("e"))
        small = small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct()
        fresh = scratch.save(small, "stars")
        mark = fresh.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = fresh
        if before == tuple(mark):
            break
        before = tuple(mark)
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    roots = edges.select(a.alias("node"), b.alias("root"))
    return roots.unionByName(edges.select(b.alias("node"), b.alias("root")).distinct())
