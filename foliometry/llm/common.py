"""Shared folder handling and small helpers for the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process (tests) a local folder is made and
    set; on a cluster each machine would write to its own disk, so there that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="foliometry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/foliometry/{name}-{uuid.uuid4().hex}"


#: Paths of the tables written and not yet removed, in order.
_TABLES: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: the lineage ends here."""
    path = shared_path(df.sparkSession, name)
    _TABLES.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_written() -> list[str]:
    return list(_TABLES)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in _TABLES:
            _TABLES.remove(path)


#: Bytes of a batch between the JVM and Python: long texts stay few to a batch.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches in bytes, so a worker's memory does not depend on the texts' length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def null_safe(*pairs: tuple[Column, Column]) -> Column:
    """Equality of all pairs in which null equals null."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & a.eqNullSafe(b)
    return out
