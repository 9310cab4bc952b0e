"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_clearing: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """Below spark.checkpoint.dir; a local folder only where driver and executors are one process. Cleared at exit."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='codeloom-')}"
        spark.sparkContext.setCheckpointDir(at)
    at = f"{at.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if at not in _clearing:
        _clearing.add(at)
        atexit.register(_clear, spark, at)
    return at


def _clear(spark: SparkSession, at: str) -> None:
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, told: list[str] | None = None) -> DataFrame:
    """df written once and read again, so what uses it several times doesn't compute it again and a lost executor costs a read. told: gets the folder, for dropped()."""
    at = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    if told is not None:
        told.append(at)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dropped(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of saved() before the session ends, once nothing reads them any more."""
    for at in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    folders.clear()
