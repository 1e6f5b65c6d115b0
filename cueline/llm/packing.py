"""Best-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueline.llm.ordering import running_total
from cueline.llm.scratch import Scratch
from cueline.llm.tokens import encoder, in_slices, vocabulary

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_into_pieces(docs: DataFrame, size: int = 2048, path: str | None = None, end_id: int = 0) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32: the token pieces of each row of ``docs`` (row, doc_id, text).

    A document is its ids and ``end_id``. One longer than ``size`` is cut into pieces of ``size``, of which the first
    holds the rest. A null text is empty and has one token.
    """
    path = path or vocabulary()

    def cut(batches):
        own = encoder(path, special=False)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows, ids = batch.column(0), batch.column(1)
            at = 0
            for texts in in_slices(batch.column(2)):
                out = [[], [], [], [], [], []]
                for k, blob in enumerate(own.encode(texts)):
                    blob += end
                    n = len(blob) // 4
                    cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        for column, x in zip(out, (rows[at + k].as_py(), ids[at + k].as_py(), piece, a, b - a, crc32(blob[4 * a : 4 * b]))):
                            column.append(x)
                at += len(texts)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit(scratch: Scratch, items: DataFrame, size: int = 2048) -> DataFrame:
    """item, bin, offset: ``items`` (distinct long ``item``, ``length`` of 1 to ``size``) in as few bins as it can.

    Bulk-synchronous best fit. A round sorts the items and gaps left by length into ranges. Swept from the longest
    down, a gap opens a bracket and an item closes the last open one: the least gap that holds it and that no
    longer item has taken. So each gap gets one item at most, and where several items reach for a gap the rank decides.
    The sweep is a running sum over the ranges (the depth of the brackets) and a window in each depth. Then the
    gaps shrink, and the next round begins, on the written table of the last. Items over half a bin open one each; when the
    gaps can't hold what is left, or a round placed nothing, the longest items left open as many bins as their tokens need
    at least. A bin has the number of the item that opened it. Rounds stop when no item is left.
    """
    length = F.col("length")
    left = items.select("item", length.cast("long").alias("length"))
    gaps = left.where(2 * length > size).select(F.col("item").alias("bin"), (size - length).alias("gap"))
    placed = [gaps.select(F.col("bin").alias("item"), "bin", F.lit(0).cast("long").alias("offset"))]
    left = scratch.save(left.where(2 * length <= size), "left")
    gaps = scratch.save(gaps.where("gap > 0"), "gaps")
    before = None
    while True:
        both = left.select("length", F.lit(None).cast("long").alias("gap")).unionByName(gaps.select(F.lit(None).cast("long").alias("length"), "gap"))
        n, tokens, least, room = both.agg(F.count("length"), F.coalesce(F.sum("length"), F.lit(0)), F.min("length"), F.coalesce(F.sum("gap"), F.lit(0))).first()
        if not n:
            break
        stuck, before = n == before, n
        lack = -(-(tokens - (0 if stuck else room)) // size)
        if lack > 0:
            order = [F.col("length").desc(), F.col("item")]
            first = running_total(scratch, left.withColumn("one", F.lit(1).cast("long")), order, "one", "rank")
            ranked = scratch.save(first.select("item", "length", (F.col("rank") < lack).alias("opens")), "ranked")
            scratch.drop(first)
            opened = ranked.where("opens")
            placed.append(opened.select("item", F.col("item").alias("bin"), F.lit(0).cast("long").alias("offset")))
            gaps = gaps.unionByName(opened.select(F.col("item").alias("bin"), (size - F.col("length")).alias("gap")))
            left = ranked.where("not opens").select("item", "length")
        gaps = gaps.where(F.col("gap") >= least)  # a smaller gap never gets an item
        events = gaps.select("bin", F.col("gap").alias("size"), F.lit(1).cast("long").alias("step")).unionByName(
            left.select(F.col("item").alias("bin"), length.alias("size"), F.lit(-1).cast("long").alias("step"))
        )
        keys = [F.col("size").desc(), F.col("step").desc(), F.col("bin")]
        scanned = running_total(scratch, events, keys, "step", "depth")
        level = F.when(F.col("step") > 0, F.col("depth") + 1).otherwise(F.col("depth"))
        by = Window.partitionBy("level").orderBy(*keys)
        ahead, behind = F.lead(F.struct("bin", "size", "step")).over(by), F.lag(F.struct("bin", "size", "step")).over(by)
        swept = scanned.withColumn("level", level).select("bin", "size", "step", ahead.alias("close"), behind.alias("open"))
        swept = scratch.save(swept, "swept")
        scratch.drop(scanned)
        # A gap that the next event of its level closes has an item; an item behind a gap has that gap.
        placed.append(swept.where("step < 0 and open.step > 0").select(F.col("bin").alias("item"), F.col("open.bin").alias("bin"), (size - F.col("open.size")).alias("offset")))
        left = swept.where("step < 0 and (open is null or open.step < 0)").select(F.col("bin").alias("item"), F.col("size").alias("length"))
        taken = F.when(F.col("close.step") < 0, F.col("close.size")).otherwise(F.lit(0))
        gaps = swept.where("step > 0").select("bin", (F.col("size") - taken).alias("gap")).where("gap > 0")
    out = placed[0]
    for x in placed[1:]:
        out = out.unionByName(x)
    return out


def pack(spark: SparkSession, docs: DataFrame, size: int = 2048, path: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: all ``docs`` (doc_id, text) as pieces in sequences.

    Each row is a document, repeated rows and null ids too; a null or empty text is one end id. An empty table
    has no sequences. Whole pieces of ``size`` are sequences already. Reads no other columns.
    """
    scratch = Scratch(spark, "packing")
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    pieces = scratch.save(cut_into_pieces(rows, size, path, end_id), "pieces")
    # The first piece of a document is the only one that may leave room.
    firsts = pieces.where(F.col("piece") == 0)
    ranked = running_total(scratch, firsts.select("row", "length", F.lit(1).cast("long").alias("one")), ["row"], "one", "item")
    numbered = scratch.save(ranked.select("row", "item", "length"), "numbered")
    scratch.drop(ranked)
    places = best_fit(scratch, numbered.where(F.col("length") < size).select("item", "length"), size)
    placed = numbered.join(places, "item", "left").select("row", "item", "bin", "offset")
    shift = 1 << 21  # more pieces than a text of 2**31 bytes can have
    full = F.col("item") * shift + F.col("piece")
    joined = pieces.join(placed, "row")
    mine = (F.col("piece") == 0) & F.col("bin").isNotNull()
    return joined.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.when(mine, F.col("bin") * shift).otherwise(full).alias("sequence_id"),
        F.when(mine, F.col("offset")).otherwise(F.lit(0)).cast("long").alias("offset"),
    )


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, end_id: int = 0) -> DataFrame:
    """sequence_id, ids array<int>: the packed token ids themselves, for ``docs`` with distinct, non-null doc_id.

    Pieces travel to their sequence one by one; a sequence is bounded by its size.
    """
    path = path or vocabulary()

    def ids(batches):
        own = encoder(path, special=False)
        for batch in batches:
            at = 0
            for texts in in_slices(batch.column(1)):
                blobs = [pa.py_buffer(x + end_id.to_bytes(4, "little")) for x in own.encode(texts)]
                values = [pa.Array.from_buffers(pa.int32(), len(x) // 4, [None, x]) for x in blobs]
                offsets = [0]
                for x in values:
                    offsets.append(offsets[-1] + len(x))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], names=["doc_id", "ids"])
                at += len(texts)

    whole = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(ids, "doc_id long, ids array<int>")
    cut = whole.join(packed, "doc_id").select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
