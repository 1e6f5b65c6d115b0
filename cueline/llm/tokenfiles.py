"""Token ids as Parquet list columns, with chosen encodings, row groups and page indexes."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.ordering import running_total
from cueline.llm.scratch import Scratch
from cueline.llm.tokens import encoder, in_slices, vocabulary


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary_path: str | None = None,
    end_id: int = 2,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 2000,
    page_bytes: int = 256 << 10,
) -> None:
    """Write doc_id, n_tokens, ids array<int> of ``docs`` (doc_id, text) in ascending doc_id order (null first).

    Each document is its ids and ``end_id``; a null text is empty. Texts are sorted before they are encoded, so
    ids never travel. ``encoding`` is how ids are stored: "dictionary" (the ids used in a row group, bit-packed)
    or "delta" (binary packed differences). Row groups and pages are bounded; the files' page
    indexes hold the range of doc_id and n_tokens in each page, so that a reader of some documents or of
    metadata alone skips the other pages and columns.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding must be dictionary or delta")
    vocabulary_path = vocabulary_path or vocabulary()
    end = end_id.to_bytes(4, "little")

    def encode(batches):
        own = encoder(vocabulary_path, special=False)
        for batch in batches:
            at = 0
            for texts in in_slices(batch.column(1)):
                blobs = [x + end for x in own.encode(texts)]
                sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
                data = b"".join(blobs)
                values = pa.Array.from_buffers(pa.int32(), len(data) // 4, [None, pa.py_buffer(data)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(sizes), lists], names=["doc_id", "n_tokens", "ids"]
                )
                at += len(texts)

    # A hash of the text parts rows that repeat one id.
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    writer = ordered.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>").write
    options = {
        "compression": "zstd",
        "maxRecordsPerFile": 0,  # a task writes one file, which its number names
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true" if encoding == "dictionary" else "false",
        "parquet.writer.version": "v1" if encoding == "dictionary" else "v2",
    }
    for k, v in options.items():
        writer = writer.option(k, str(v))
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The token files at ``path``; ``columns`` alone are read, and filters on doc_id or n_tokens reach the pages."""
    table = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    return table.select(*columns) if columns else table


def token_starts(spark: SparkSession, scratch: Scratch, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the token files at ``path``: ids before each document as the files have it, and their checksum."""

    def digest(batches):
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            data = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
            sums = [crc32(data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            sizes = np.diff(offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], batch.column(3), pa.array(sizes), pa.array(sums, pa.int64())], names=["file", "place", "doc_id", "n_tokens", "ids_crc32"]
            )

    # Files are numbered in the order of their ranges; a row's place is its place in the file.
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("file")
    table = read_tokens(spark, path).select(number, F.col("_metadata.row_index").alias("place"), "ids", "doc_id")
    found = table.mapInArrow(digest, "file int, place long, doc_id long, n_tokens long, ids_crc32 long")
    # Written once: a range partitioning reads its input twice.
    found = running_total(scratch, scratch.save(found, "digests"), ["file", "place"], "n_tokens", "start")
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def token_digests(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` as token files in the shared folder, read them back, and return doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have their end id alone; repeated ids follow each other in the order of their texts, by range of a hash of them;
    a null id comes first. start is where the files have the document. No rows: no files with rows, no result rows. Other columns are not read.
    """
    scratch = Scratch(spark, "tokenfiles")
    path = scratch.path("tokens")
    write_tokens(docs, path, **options)
    return token_starts(spark, scratch, path)
