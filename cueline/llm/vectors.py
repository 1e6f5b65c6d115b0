"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.components import components
from cueline.llm.scratch import Scratch

THRESHOLD = 0.98
#: Vectors that the centroids are fitted on, at most.
SAMPLE = 20_000


def _unit(lists: pa.ListArray) -> np.ndarray:
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = lists.offsets.to_numpy()
    x = values[offsets[0] : offsets[-1]].reshape(len(lists), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors: each is moved to the direction of the sum of those nearest to it by cosine."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norms = np.sqrt((sums * sums).sum(1))
        c = np.where((norms > 1e-12)[:, None], sums / np.maximum(norms, 1e-12)[:, None], c)
    return c


def _assign(classes: DataFrame, centres: dict, threshold: float) -> DataFrame:
    """node, n, x, label, cell, home: each vector in its cell, and in each later cell where it may have a partner.

    If x and y are linked, unit vectors are at most d = sqrt(2 - 2 * threshold) apart. If y's cell is another one, the
    plane that divides the two cells' centres lies between x and y, so x is within d of that plane. Such a pair is
    compared in the cell with the greater number, where the vector of the smaller one is a visitor.
    """
    reach = np.sqrt(2 - 2 * threshold) + 1e-9

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column(2).value_lengths().to_numpy()
            for size in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == size)))
                x, rows, cells, home = _unit(part.column(2)), [], [], []
                c = centres.get(int(size), np.zeros((1, int(size))))
                apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
                for i in range(0, len(x), 1024):
                    cos = x[i : i + 1024] @ c.T
                    own = cos.argmax(1)
                    lead = cos[np.arange(len(cos)), own][:, None] - cos
                    near = (lead <= reach * apart[own] + 1e-9) & (np.arange(len(c)) > own[:, None])
                    near[np.arange(len(cos)), own] = True
                    r, j = np.nonzero(near)
                    rows.append(r + i), cells.append(j), home.append(j == own[r])
                rows, cells, home = np.concatenate(rows), np.concatenate(cells), np.concatenate(home)
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cells.astype(np.int32)), pa.array(home)], names=["node", "n", "x", "label", "cell", "home"]
                )

    kind = classes.schema["label"].dataType.simpleString()
    vector = classes.schema["x"].dataType.simpleString()
    return classes.select("node", "n", "x", "label").mapInArrow(
        run, f"node long, n long, x {vector}, label {kind}, cell int, home boolean"
    )


def _compare(dealt: DataFrame, threshold: float, block: int) -> DataFrame:
    """a, b, n: for each node, partners found in one pair of blocks (rows of partners), as ``a`` -> least ``b``, and how many rows they stand for."""

    def pair(table: pa.Table) -> pa.Table:
        lists = table.column("x").combine_chunks()
        x = _unit(lists if isinstance(lists, pa.ListArray) else lists.chunk(0))
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        home = np.asarray(table.column("home").to_numpy(zero_copy_only=False), bool)
        side, same = table.column("side").to_numpy(), bool(table.column("same")[0].as_py())
        left = np.arange(len(node)) if same else np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        links, parent = np.zeros(len(node), np.int64), np.arange(len(node))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in range(0, len(left), 256):
            rows = left[i : i + 256]
            near = x[rows] @ x[right].T >= threshold
            near &= home[rows][:, None] | home[right]  # two visitors are compared at home
            near &= node[rows][:, None] != node[right]
            links[rows] += near @ n[right]
            if not same:
                links[right] += n[rows] @ near
            for k in np.flatnonzero(near.any(1)):
                own = right[near[k]]
                own = own[parent[own] != parent[rows[k]]]
                if len(own):
                    r = root(rows[k])
                    for j in own:
                        s = root(j)
                        if s != r:
                            parent[s] = r
                    parent[own] = r
                    parent[rows[k]] = r
        found = np.flatnonzero(links)
        roots = np.array([root(i) for i in found], np.int64)
        return pa.table({"a": node[found], "b": node[roots] if len(found) else node[:0], "n": links[found]})

    return dealt.groupBy("label", "size", "cell", "i", "j").applyInArrow(pair, "a long, b long, n long")


def link_vectors(
    spark: SparkSession, table: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, cell: int = 1500, block: int = 1500
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``table`` (vec_id, embedding, label).

    Vectors are compared when their labels are equal and not null, their lengths are equal and their cosine, in double precision, is ``threshold`` or more.
    Rows with equal label and vector are one class: its least vec_id stands for all, and links count rows. Spherical
    k-means on a bounded sample (``sample`` vectors) cuts the space into about one cell for ``cell`` vectors of the
    largest label. Within label and cell, vectors are compared in blocks of ``block``; a pair across cells is found because one of the two visits the other's cell (see ``_assign``), so no
    link is lost. A pair of blocks returns one row a vector: its links and a vector of its local group, never the pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without label or vec_id, link with
    nothing: n_links 0, component_id their vec_id. Rows that share a vec_id are one vertex for component_id. No rows give no rows. Other columns are not read.
    """
    scratch = Scratch(spark, "vectors")
    own = table.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    wide = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(wide, lambda v: v != 0)
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("embedding") > 0) & sound, F.lit(False))
    own = scratch.save(own.withColumn("fine", fine), "vectors")
    good = own.where("fine").withColumn("size", F.size("embedding"))
    classes = good.groupBy("label", F.col("embedding").alias("x"), "size").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    classes = scratch.save(classes, "classes")
    sizes = {r["size"]: r["most"] for r in classes.groupBy("label", "size").count().groupBy("size").agg(F.max("count").alias("most")).orderBy(F.desc("most")).limit(64).collect()}
    centres = {}
    for size, most in sizes.items():
        k = -(-most // cell)
        if k > 1:
            # The least hashes are a sample that reruns repeat; its size is the bound.
            rows = classes.where(F.col("size") == size).orderBy(F.xxhash64("node"), "node").limit(min(sample, max(1000, 4_000_000 // size))).select("x").toArrow()
            lists = rows.column("x").combine_chunks()
            centres[size] = spherical_kmeans(_unit(lists), min(int(k), sample // 20))
    placed = _assign(classes, centres, threshold).withColumn("size", F.size("x"))
    placed = scratch.save(placed, "cells")
    keys = ["label", "size", "cell"]
    blocks = placed.groupBy(*keys).agg(F.count("*").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / block).cast("int")).drop("rows")
    dealt = placed.join(blocks, keys).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("*", others).select(
        "node", "n", "x", "home", *keys,
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), (F.col("own") == F.col("other")).alias("same"),
    )
    found = scratch.save(_compare(dealt, threshold, block), "found")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    links = found.where("a != b").select("a", "b")
    groups = components(scratch, links)
    keyed = classes.select(F.col("label"), F.col("x").alias("embedding"), "node", "n").join(counts, "node", "left").join(groups, "node", "left")
    marked = keyed.select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "node").alias("root")
    )
    linked = own.where("fine").join(marked, ["label", "embedding"]).select("vec_id", F.col("links").alias("n_links"), F.col("root").alias("component_id"))
    alone = own.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
