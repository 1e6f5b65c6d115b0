"""Intermediate tables in the folder that the whole cluster shares.

Iterative operators cut their lineage by writing a Parquet table and reading it
back. The folder is the one named in ``spark.checkpoint.dir``, so a lost executor
costs a task and never an intermediate result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row's number in its written table, where doc_id may be null or repeated. No input column may have this name.
ROW = "_cueline_row"
#: Bounds what a Python worker gets at a time; set for the session where it is unset.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session may go without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cueline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables of one run of an operator, each written once and read from the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cueline-{name}-{uuid.uuid4().hex[:12]}"
        self._tables = 0
        self._saved: list[DataFrame] = []
        # Texts may be long: tasks get few bytes of them at a time, unless the session says otherwise.
        if spark.conf.get(BATCH_BYTES, None) is None:
            spark.conf.set(BATCH_BYTES, "4m")

    def path(self, name: str) -> str:
        self._tables += 1
        return f"{self.root}/{self._tables:04d}-{name}"

    def save(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write ``df`` and return a DataFrame over the written rows."""
        path = self.path(name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.cueline_path = path
        self._saved.append(table)
        return table

    def number(self, df: DataFrame) -> DataFrame:
        """``df`` with a distinct ``_row`` for each row, written, as numbers may differ when they are computed again."""
        return self.save(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered")

    def drop(self, table: DataFrame | None) -> None:
        """Delete a saved table that no later step reads; a running total stands for the table that it reads."""
        path = getattr(table, "cueline_path", None)
        if path:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
            self._saved = [t for t in self._saved if t.cueline_path != path]

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all saved tables of this run but ``tables``. What a lazy result reads must be among them."""
        kept = {t.cueline_path for t in tables}
        for table in [t for t in self._saved if t.cueline_path not in kept]:
            self.drop(table)
