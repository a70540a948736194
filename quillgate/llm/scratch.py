"""Intermediate tables in the cluster's shared folder.

A table written here is read back from storage, so the plan that made it is
cut off and a lost executor costs one re-read, never a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch while Python works on whole texts: batches bound what workers and executors hold.
BATCH_ROWS = 2000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for the jobs that run inside; the session's own setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(before) if int(before) > 0 else BATCH_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scratch_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only in local mode where that is unset (tests), an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillgate-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Named Parquet tables under one fresh folder of the shared scratch root."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            where = jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(conf).delete(where, True)
