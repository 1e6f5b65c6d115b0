"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset overlap."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.components import components
from cueline.llm.scratch import ROW, Scratch
from cueline.llm.texts import WORDS, mix, multisets, shingle_hashes, slices

_U = np.uint64
THRESHOLD, BANDS, BAND_SIZE = 0.8, 40, 5
#: Texts in a bucket from which its pairs are verified in blocks.
LARGE = 40
#: Bytes of text in a block of such a bucket, about and beyond one text.
MEETING_BYTES = 32 << 20
#: Companions of a hub that are compared with one copy of its text, about.
SPREAD = 1000


def signatures(hashes: np.ndarray, counts: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """BagMinHash signatures (rows of ``size`` floats) of multisets given as distinct hashes with counts.

    The weight of a shingle is its count, discretised at the whole numbers. Its axis is cut into the levels
    [0, 1), [1, 2), [2, 4), [4, 8) and so on. Each level has a Poisson process of its own, seeded by shingle and level, with the
    level's length as its rate; a point has a time, a component and a height in the level, and is there for all weights
    above its height. A component of the signature is the time of the first point that falls to it. Two
    multisets have equal components with the probability of their weighted Jaccard similarity. Processes go on only while
    they may still bring something earlier than the last component of their document, so a signature costs
    about as many points as it has components, not components times shingles. Empty multisets keep infinite times.
    """
    n = len(begins) - 1
    out = np.full((n, size), np.inf)
    if not len(hashes):
        return out
    levels = np.ceil(np.log2(counts)).astype(np.int64) + 1
    item = np.repeat(np.arange(len(hashes)), levels)
    level = np.arange(len(item)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.where(level == 0, 1, low)
    weight = counts[item]
    doc = np.repeat(np.arange(n), np.diff(begins))[item]
    seed = mix(hashes[item] + mix(level.astype(_U) + _U(0x51)))
    at, step = np.zeros(len(item)), np.zeros(len(item), np.int64)
    live = np.arange(len(item))
    flat = out.ravel()
    while len(live):
        points = int(min(128, max(1, 8192 // len(live))))
        places = (step[live][:, None] + np.arange(1, points + 1)).astype(_U)
        first = mix(seed[live][:, None] + places * _U(0x9E3779B97F4A7C15))
        wait = -np.log1p(-((first >> _U(11)).astype(float) * 2.0**-53)) / width[live][:, None]
        # Waits are added one by one from the carried time: a point's bits don't depend on how many points a step has.
        times = np.cumsum(np.concatenate((at[live][:, None], wait), axis=1), axis=1)[:, 1:]
        second = mix(first ^ _U(0xD6E8FEB86659FD93))
        component = ((second >> _U(32)) * _U(size)) >> _U(32)
        height = low[live][:, None] + (((second & _U(0xFFFFFFFF)) * width[live][:, None].astype(_U)) >> _U(32)).astype(np.int64)
        cells = doc[live][:, None] * size + component.astype(np.int64)
        there = height < weight[live][:, None]
        np.minimum.at(flat, cells[there], times[there])
        at[live] = times[:, -1]
        step[live] += points
        own = doc[live]  # in order
        docs = own[np.concatenate(([True], own[1:] != own[:-1]))]
        last = out[docs].max(1)
        live = live[at[live] < last[np.searchsorted(docs, own)]]
    return out


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash for each band of each row."""
    rows = signature.view(_U).reshape(len(signature), bands, -1)
    out = np.zeros(rows.shape[:2], _U)
    for k in range(rows.shape[2]):
        out = mix(out * _U(31) + rows[:, :, k])
    return mix(out + np.arange(bands, dtype=_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def _sign(docs: DataFrame, bands: int, size: int, words: int) -> DataFrame:
    """row, doc_id, key, bands, code: each text's checksum, band hashes (none for texts without words) and a byte of each component."""

    def run(batches):
        for batch in batches:
            at = 0
            for blobs in slices(batch.column(2)):
                keys = [hashlib.blake2b(x, digest_size=16).digest() for x in blobs]
                hashes, counts, begins = multisets(*shingle_hashes(blobs, words), len(blobs))
                signed = signatures(hashes, counts, begins, bands * size)
                found = band_hashes(signed, bands)
                codes = (mix(signed.view(_U)) >> _U(56)).astype(np.uint8)
                sizes = np.where(np.diff(begins) > 0, bands, 0)
                values = found[sizes > 0].ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(at, len(blobs)) for k in range(2)), pa.array(keys, pa.binary()), lists, pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=["row", "doc_id", "key", "bands", "code"],
                )
                at += len(blobs)

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, key binary, bands array<long>, code binary")


def _overlap(a, b) -> float:
    """Weighted Jaccard similarity of two multisets (hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """a, b, similarity of those ``pairs`` (a, b) whose ``texts`` (node, text) overlap enough, and all others with 0."""

    def run(batches):
        last = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for blobs in slices(batch.column(3), 200, 1_000_000):
                centres = [batch.column(2)[k] for k in range(at, at + len(blobs)) if a[k] not in last]
                fresh = dict(zip([x for x in a[at : at + len(blobs)] if x not in last], centres))
                todo = list(fresh)
                own = [fresh[x].as_buffer().to_pybytes() for x in todo]
                sets = {}
                hashes, counts, begins = multisets(*shingle_hashes(own + blobs, words), len(own) + len(blobs))
                split = [(hashes[x:y], counts[x:y]) for x, y in zip(begins, begins[1:])]
                sets = last | dict(zip(todo, split))
                found = [_overlap(sets[a[at + k]], split[len(own) + k]) for k in range(len(blobs))]
                last = {a[at + len(blobs) - 1]: sets[a[at + len(blobs) - 1]]}
                out = [pa.array(a[at : at + len(blobs)]), pa.array(b[at : at + len(blobs)]), pa.array(found, pa.float64())]
                yield pa.RecordBatch.from_arrays(out, names=["a", "b", "similarity"])
                at += len(blobs)

    # A hub's companions are dealt out by hash to parts of about SPREAD, each with its own copy of the hub's text.
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts")).where("parts > 1")
    dealt = pairs.join(hot, "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    centres = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(hot, "a", "left")
    centres = centres.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    other = dealt.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = other.join(centres, ["a", "part"])
    checked = both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")
    return checked.withColumn("linked", F.col("similarity") >= threshold)


def _overlaps(sets: list, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of the pairs (x, y) of multisets (hashes, counts).

    A count is as many unit elements. Many pairs of few multisets are products of 0/1 matrices, a slice of the unit elements
    that at least two of them share at a time.
    """
    rows = np.unique(np.concatenate((x, y)))
    if len(x) <= 20 * len(rows):
        return np.array([_overlap(sets[i], sets[j]) for i, j in zip(x, y)])
    units, owner = [], []
    for k, i in enumerate(rows):
        hashes, counts = sets[i]
        level = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        units.append(mix(np.repeat(hashes, counts) + mix(level.astype(_U))))
        owner.append(np.full(len(level), k))
    units, owner = np.concatenate(units), np.concatenate(owner)
    _, column, times = np.unique(units, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    place = np.cumsum(times > 1) - 1
    column, owner = place[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both, width = np.zeros((len(rows), len(rows)), np.float32), 2048
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (start, start + width))
        part = np.zeros((len(rows), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        both += part @ part.T
    sizes = np.array([sets[i][1].sum() for i in rows], float)
    i, j = np.searchsorted(rows, x), np.searchsorted(rows, y)
    return both[i, j] / np.maximum(sizes[i] + sizes[j] - both[i, j], 1)


def _meetings(rows: DataFrame, threshold: float, size: int, words: int, verify: bool, block: int) -> DataFrame:
    """a, b: pairs of a bucket, of different groups, whose signatures agree about as often as those of near copies.

    ``rows`` are band, node, root, code, n and bytes of the bucket, text. A bucket is cut into blocks of bounded rows and bytes by a hash, and pairs of blocks are compared as arrays in a stream, so
    a large bucket is many tasks' work. A pair at ``threshold`` agrees less often than the cut asks for with a probability of 1e-7
    (5.3 standard deviations). With ``verify`` the pairs that agree are compared by their multisets at once, and each text that is linked
    comes with one text of its local group, so never more rows leave a block than it has texts; else the pairs that agree are given.
    """
    least = (threshold - 5.3 * np.sqrt(threshold * (1 - threshold) / size)) * size

    def near_pairs(root, code, home):
        left, right = np.flatnonzero(home == 0), np.flatnonzero(home == 1)
        same = not len(right)
        right = left if same else right
        for i in range(0, len(left), 64):
            rows = left[i : i + 64]
            agree = (code[rows][:, None, :] == code[right][None, :, :]).sum(2)
            near = (agree >= least) & (root[rows][:, None] != root[right])
            if same:
                near &= rows[:, None] < right
            x, y = np.nonzero(near)
            yield np.stack((rows[x], right[y]))

    def linked(x, y, texts, n):
        """Stars of the groups that verified pairs make."""
        involved = np.unique(np.concatenate((x, y)))
        sets = {}
        for i in range(0, len(involved), 200):
            part = involved[i : i + 200]
            hashes, counts, begins = multisets(*shingle_hashes([texts[k] for k in part], words), len(part))
            sets |= {k: (hashes[p:q], counts[p:q]) for k, p, q in zip(part, begins, begins[1:])}
        keep = _overlaps(sets, x, y) >= threshold
        x, y, top = x[keep], y[keep], np.arange(n)
        while True:  # the least row of each group spreads along its links
            low = np.minimum(top[x], top[y])
            fresh = top.copy()
            np.minimum.at(fresh, x, low)
            np.minimum.at(fresh, y, low)
            fresh = fresh[fresh]
            if (fresh == top).all():
                break
            top = fresh
        moved = np.flatnonzero(top != np.arange(n))
        return moved, top[moved]

    def run(batches):
        key, held = None, []

        def done():
            node, root, code, home = (np.concatenate([h[k] for h in held]) for k in range(4))
            found = list(near_pairs(root, code.reshape(-1, size), home))
            x, y = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            if verify and len(x):
                x, y = linked(x, y, [t for h in held for t in h[4]], len(node))
            a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            band, i, j, node, root, home = (batch.column(k).to_numpy() for k in range(6))
            codes = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, size)
            texts = [t.as_buffer().to_pybytes() for t in batch.column(7)] if verify else [b""] * len(band)
            cuts = np.flatnonzero((np.diff(band) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for x, y in zip([0, *cuts], [*cuts, len(band)]):
                own = band[x], i[x], j[x]
                if own != key and held:
                    yield done()
                    held = []
                key = own
                held.append((node[x:y], root[x:y], codes[x:y].ravel(), home[x:y], texts[x:y]))
        if held:
            yield done()

    needed = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / MEETING_BYTES))
    dealt = rows.withColumn("blocks", needed.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    dealt = dealt.select("band", i, j, "node", "root", (F.col("own") > F.col("other")).cast("int").alias("home"), "code", *(["text"] if verify else []))
    return dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, band_size: int = BAND_SIZE, words: int = WORDS,
    row: str | None = None,
) -> DataFrame:
    """doc_id, class_id, kept for each row of ``docs`` (doc_id, text): groups of documents joined by near copies.

    Near copies have a weighted Jaccard similarity of ``threshold`` or more between their multisets of shingles
    of ``words`` words. Equal texts fall together first. Of the others, candidates share a band: with 40 bands of 5 a pair at 0.8 is missed
    with a probability of 1e-7. In each band's bucket all texts are compared with its hub, the one with the most
    companions over all its buckets (in a group of edited copies, the original), which links most groups with one comparison
    for each text. Then all pairs of a bucket that are still in different groups, and were not compared, are tested too: first by how
    many components of their signatures agree, in blocks, then by their texts (in large buckets in the same blocks, which return links by group, not by pair). So every candidate pair is tested, or its texts are in one group already.
    A bucket is only ever grouped for its hub and its groups, with partial aggregation.

    class_id is the smallest doc_id of the group, null if no row of it has one; kept is true for exactly one row of each group, the first with that id. Rows
    are told apart by their number, never by doc_id: rows that share an id are in one group only if their texts are, and rows without an id are
    like others. Texts under ``words`` words are one shingle; texts without words are copies of texts equal to them only. A null text is empty.
    An empty table gives no rows. Other columns are not read.
    ``row`` names a column of distinct longs in a written table that is given back too, to tell rows apart; else the rows are numbered in a written table here.
    """
    scratch = Scratch(spark, "bagminhash")
    numbered = docs if row else scratch.number(docs.select("doc_id", "text"))
    own = numbered.select(F.col(row or ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = scratch.save(_sign(own, bands, band_size, words), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    classes = scratch.save(signed.groupBy("key").agg(F.min("row").alias("node"), F.first("bands").alias("bands"), F.first("code").alias("code"), least), "classes")
    keys = scratch.save(signed.select("row", "doc_id", "key"), "keys")
    scratch.drop(signed)

    # Buckets with company, and each text's number of companions over all of them.
    banded = classes.select("node", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.save(banded.join(sizes, "band"), "buckets")
    rank = shared.groupBy("node").agg(F.sum("n").alias("rank"))
    ranked = scratch.save(shared.select("band", "node").join(rank, "node"), "ranked")
    hub = ranked.groupBy("band").agg(F.max_by("node", F.struct("rank", -F.col("node"))).alias("hub"))
    stars = ranked.join(hub, "band").where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    # Of the two directions that buckets may give a pair, one is compared.
    stars = stars.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b"))
    stars = scratch.save(stars.groupBy("low", "high").agg(F.min_by("a", "a").alias("a"), F.min_by("b", "a").alias("b")).select("a", "b"), "stars")

    nodes = shared.select("node").distinct()
    texts = own.join(nodes, own["row"] == nodes["node"], "left_semi").select(F.col("row").alias("node"), "text", F.octet_length("text").alias("size"))
    texts = scratch.save(texts, "texts")
    first = scratch.save(_verified(stars, texts, threshold, words).select("a", "b", "linked"), "compared")

    links = first.where("linked").select("a", "b")
    groups = scratch.save(components(scratch, links), "groups")
    labelled = ranked.select("band", "node").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Buckets where groups meet: all pairs across groups that were not compared.
    mixed = labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("band")
    meeting = scratch.save(labelled.join(mixed, "band", "left_semi"), "meeting")
    # In small buckets the pairs that agree are few for each text; in large ones they are verified where they meet.
    sizes = meeting.groupBy("band").agg(F.count("*").alias("n"))
    meeting = meeting.join(sizes, "band").join(classes.select("node", "code"), "node")
    size = bands * band_size
    few = meeting.where(F.col("n") < LARGE).withColumn("bytes", F.lit(0))
    across = _meetings(few, threshold, size, words, False, LARGE).distinct()
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = scratch.save(across.join(done, ["a", "b"], "left_anti"), "across")
    second = scratch.save(_verified(across, texts, threshold, words).where("linked").select("a", "b"), "found")
    many = meeting.where(F.col("n") >= LARGE)
    held = many.select("band", "node").join(texts.select("node", "size"), "node").groupBy("band").agg(F.sum("size").alias("bytes"))
    large = many.join(held, "band").join(texts.select("node", "text"), "node")
    second = second.unionByName(scratch.save(_meetings(large, threshold, size, words, True, 500), "large"))

    groups = components(scratch, links.unionByName(second))
    tops = classes.select("key", "node", "least").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tops = scratch.save(tops.select("key", "root", "least"), "tops")
    # The result is lazy; these two are all it reads.
    scratch.keep_only(keys, tops)
    best = tops.groupBy("root").agg(F.min("least").alias("best"))
    named = tops.join(best, "root").select("key", F.col("best.doc_id").alias("class_id"), F.col("best.row").alias("first"))
    out = keys.join(named, "key")
    return out.select(*([F.col("row").alias(row)] if row else []), "doc_id", "class_id", (F.col("row") == F.col("first")).alias("kept"))
