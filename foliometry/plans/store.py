"""Tables between the stages of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="foliometry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def unsized(df: DataFrame) -> DataFrame:
    """``df``, joined by sorting only: what Spark takes for its size is far too small.

    Spans pack to a byte or two a row in files, and rows that a few keys grow to count as the keys: Spark would collect
    such a table on the driver to broadcast it.
    """
    return df.hint("merge")


class Scratch:
    """The tables of one plan: called with a DataFrame, writes it to a folder of its own and reads it back.

    ``remove`` deletes them all; results that were not written elsewhere cannot be read any more. As a
    context manager it does so at the end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{folder(spark)}/foliometry/plan-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return unsized(self.spark.read.schema(df.schema).parquet(path))

    def remove(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.remove()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, for as long as the folder is kept."""
    return Scratch(df.sparkSession)(df)
