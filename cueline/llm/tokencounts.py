"""Token counts of documents in flat files of token ids that have no index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.ordering import running_total
from cueline.llm.scratch import Scratch
from cueline.llm.tokens import encoder, in_slices, vocabulary

TOKENS, NAMES = "0", "1"


def _end(end_id: int, width: int) -> bytes:
    return end_id.to_bytes(width, "little")


def write_flat(docs: DataFrame, path: str, vocabulary_path: str | None = None, end_id: int = 50256, width: int = 2) -> None:
    """Write the ids of ``docs`` (doc_id, text), each document with ``end_id`` behind it, as flat little-endian numbers.

    Two folders: ``kind=0`` has the token files, of ``width`` bytes an id, and ``kind=1`` for each of them the list of
    its documents' ids in order, without places or lengths. Both come from one job, so they always agree.
    The files are what Spark's text writer makes of lines of raw bytes, with the end id as the line end.
    A null text is empty; no text contains ``end_id``, as special tokens' strings are ordinary text.
    """
    vocabulary_path = vocabulary_path or vocabulary()
    kind = f"<u{width}"

    def encode(batches):
        own, seq = encoder(vocabulary_path, special=False), 0
        for batch in batches:
            at = 0
            for texts in in_slices(batch.column(1)):
                blobs = [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in own.encode(texts)]
                names = ["" if x is None else str(x) for x in batch.column(0).slice(at, len(texts)).to_pylist()]
                order = pa.array(np.arange(seq, seq + len(texts)))
                for k, values in ((0, blobs), (1, [x.encode() for x in names])):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(texts), k, np.int32)), order, pa.array(values, pa.binary())], names=["kind", "seq", "value"]
                    )
                seq += len(texts)
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "kind int, seq long, value binary")
    rows = rows.sortWithinPartitions("kind", "seq").select("kind", F.col("value").cast("string").alias("value"))
    writer = rows.write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", _end(end_id, width).decode("latin-1"))
    writer.text(path)


def scan_flat(scratch: Scratch, files: DataFrame, end_id: int = 50256, width: int = 2, block: int = 1 << 20) -> DataFrame:
    """doc_no, file, start, n_tokens, ended: the documents in flat token ``files`` (path, content), in order of path.

    The files are one stream, cut into blocks of ``block`` ids. In each block all ends are found by one vectorised comparison.
    A block has the ends of the documents that it closes, and pieces at its borders. Running sums over the blocks number
    documents and tokens; pieces with the same document number, in one file or several, are then added up. n_tokens counts the
    end. Tokens after the last end are a document that has not ended. An odd rest of a file, shorter than an id, is an error.
    """
    kind = f"<u{width}"

    def cut(batches):
        names = ["path", "block", "local", "begin", "n_tokens", "ended", "ends", "tokens"]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                if data.size % width:
                    raise ValueError(f"{path} ends within an id")
                ids = np.frombuffer(data, kind)
                for at in range(0, len(ids), block):
                    part = ids[at : at + block]
                    ends = np.flatnonzero(part == end_id) + 1
                    begin = np.concatenate(([0], ends))
                    upto = np.concatenate((ends, [len(part)]))
                    n = len(begin)
                    closed = np.ones(n, bool)
                    closed[-1] = False
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path] * n), pa.array(np.full(n, at // block)), pa.array(np.arange(n)), pa.array(begin),
                            pa.array(upto - begin), pa.array(closed), pa.array(np.full(n, len(ends))), pa.array(np.full(n, len(part))),
                        ],
                        names=names,
                    )

    pieces = files.select("path", "content").mapInArrow(
        cut, "path string, block long, local long, begin long, n_tokens long, ended boolean, ends long, tokens long"
    )
    pieces = scratch.save(pieces, "pieces")
    blocks = pieces.where("local = 0").select("path", "block", "ends", "tokens")
    blocks = running_total(scratch, blocks, ["path", "block"], "ends", "ends_before")
    blocks = running_total(scratch, blocks, ["path", "block"], "tokens", "tokens_before")
    blocks = blocks.select("path", "block", "ends_before", "tokens_before")
    placed = pieces.join(blocks, ["path", "block"]).select(
        (F.col("ends_before") + F.col("local")).alias("doc_no"),
        "path",
        (F.col("tokens_before") + F.col("begin")).alias("start"),
        "n_tokens",
        "ended",
        ((F.col("local") == 0) | (F.col("local") == F.col("ends"))).alias("border"),
    )
    whole = placed.where("not border").drop("border")
    stitched = (
        placed.where("border and n_tokens > 0")
        .groupBy("doc_no")
        .agg(F.min_by("path", "start").alias("path"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.max("ended").alias("ended"))
    )
    return whole.unionByName(stitched).select("doc_no", F.col("path").alias("file"), "start", "n_tokens", "ended")


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the files in a folder; each file (2 GB at most) is held whole by one task."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _named(files: DataFrame, end: bytes) -> DataFrame:
    """part, local, doc_id from the lists of names."""

    def split(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                names = content.as_py().split(end)[:-1]
                ids = pa.array([int(x) if x else None for x in names], pa.int64())
                part = pa.array([path.rsplit("/", 1)[1].split(".")[0]] * len(names), pa.string())
                yield pa.RecordBatch.from_arrays([part, pa.array(np.arange(len(names))), ids], names=["part", "local", "doc_id"])

    return files.mapInArrow(split, "part string, local long, doc_id long")


def count_tokens(spark: SparkSession, docs: DataFrame, end_id: int = 50256, width: int = 2, **options) -> DataFrame:
    """doc_id, doc_no, start, n_tokens of all ``docs`` (doc_id, text), from flat token files written to the shared folder.

    doc_no numbers documents in the stream and start counts the ids before. Null and empty texts have one token, the end.
    Null and repeated ids keep their rows. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(spark, "tokencounts")
    path = scratch.path("flat")
    write_flat(docs, path, end_id=end_id, width=width)
    if not docs.select("doc_id").take(1):
        return spark.createDataFrame([], "doc_id long, doc_no long, start long, n_tokens long")
    found = scan_flat(scratch, read_flat(spark, f"{path}/kind={TOKENS}"), end_id, width, **options)
    found = scratch.save(found.withColumn("part", F.regexp_extract("file", r"([^/.]+)[^/]*$", 1)), "documents")
    firsts = found.groupBy("part").agg(F.min("doc_no").alias("first"))
    found = found.join(firsts, "part").withColumn("local", F.col("doc_no") - F.col("first"))
    names = _named(read_flat(spark, f"{path}/kind={NAMES}"), _end(end_id, width))
    return found.join(names, ["part", "local"], "left").select("doc_id", "doc_no", "start", "n_tokens")
