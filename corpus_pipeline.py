"""A corpus from raw documents to packed training sequences, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm import bagminhash, mixing, packing, toxicity
from cueline.llm.scratch import ROW, Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the labelled examples' vote doesn't reject, whatever their doc_id. Learns from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    # A row passes through its own scoring, so nothing is numbered, written or joined.
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_whole"))
    return toxicity.score_toxicity(spark, whole, labels, keep=("_whole",)).where("predicted = 0").select("_whole.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the first with the smallest id; a row without an id has a hash of its text for it."""
    numbered = Scratch(spark, "copies").number(docs)
    others = bagminhash.near_duplicates(spark, numbered, row=ROW).where("not kept").select(ROW)
    return numbered.join(others, ROW, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and copies, each with its place in a sequence."""
    return packing.pack(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages go beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is a table in the shared folder that the next one reads."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.keep_only(docs)
    return docs
