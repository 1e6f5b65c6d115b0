"""Intermediate tables of iterative operators, in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Rounds:
    """Tables of one run, each written once; a lost executor costs a task, not a round."""

    def __init__(self, spark: SparkSession, name: str):
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="cueline-")
            spark.conf.set("spark.checkpoint.dir", folder)
        self.spark, self.root, self.n = spark, f"{folder.rstrip('/')}/cueline-{name}-{uuid.uuid4().hex[:12]}", 0

    def save(self, df: DataFrame, name: str = "round") -> DataFrame:
        """Write ``df``; the result reads the written rows."""
        self.n += 1
        path = f"{self.root}/{self.n:04d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def several(self, tables: list[DataFrame]) -> DataFrame:
        """All rows of tables of one schema that this run saved."""
        return self.spark.read.schema(tables[0].schema).parquet(*[p for t in tables for p in t.inputFiles()]) if tables else None
