"""Sinks for timelines, frames, scene trees and annotations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.errors import DatasetError


def write_timeline(table: DataFrame, path: str, kind: str, source: str, mode: str = "errorifexists", **meta) -> None:
    """Write a timestamped table as Parquet, and its metadata (type, source, n_entries and more) beside it."""
    if not path.endswith(".parquet"):
        path += ".parquet"
    table.write.mode(mode).parquet(path)
    spark = table.sparkSession
    n = spark.read.parquet(path).count()
    meta = {"type": kind, "source": source, "n_entries": str(n)} | {k: str(v) for k, v in meta.items()}
    spark.createDataFrame([(meta,)], "metadata map<string,string>").coalesce(1).write.mode(mode).json(f"{path}.meta")


def read_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """The metadata that was written beside a table."""
    row = spark.read.schema("metadata map<string,string>").json(f"{path}.meta").first()
    if row is None:
        raise DatasetError(f"{path} has no metadata")
    return dict(row["metadata"])


def write_frames(frames: DataFrame, path: str, kind: str, source: str, **meta) -> None:
    """Write sprites or shots: frames as binary beside their timestamps."""
    write_timeline(frames.withColumn("timestamp", F.col("timestamp").cast("double")), path, kind, source, **meta)


def write_scenes(trees: DataFrame, path: str) -> None:
    """Write scene trees as JSON lines, one scene each."""
    trees.write.json(path)


def scenes_json(trees: DataFrame, indent: int = 2) -> str:
    """The scene trees of one screenplay as an indented JSON text."""
    return json.dumps([json.loads(x) for x in trees.orderBy("scene_no").toJSON().collect()], indent=indent, ensure_ascii=False)


def write_annotations(annotated: DataFrame, path: str, error_path: str, frame: str = "frame") -> None:
    """Append annotations to ``path`` and failures to ``error_path``, as JSON lines without the pixels."""
    own = annotated.drop(frame)
    own.where("error is null").drop("error").write.mode("append").json(path)
    own.where("error is not null").drop("annotation").write.mode("append").json(error_path)
