"""Cutting lineage so that a lost executor cannot change an intermediate result."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# Folders written so far, deleted by release() or when Python ends.
_folders: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    if context.master.startswith("local-cluster") or not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="goldsieve-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    folder = f"{shared_folder(spark).rstrip('/')}/goldsieve-{label}-{uuid.uuid4().hex}"
    _folders.append(folder)
    return folder


def release() -> None:
    """Delete every intermediate folder of this process; their tables are gone then."""
    gateway = SparkContext._gateway
    if gateway is not None:
        path = gateway.jvm.org.apache.hadoop.fs.Path
        active = SparkContext._active_spark_context
        conf = (
            active._jsc.hadoopConfiguration()
            if active is not None and active._jsc is not None
            else gateway.jvm.org.apache.hadoop.conf.Configuration()
        )
        for folder in _folders:
            found = path(folder)
            found.getFileSystem(conf).delete(found, True)
    _folders.clear()


@atexit.register
def _at_end() -> None:
    try:
        release()
    except Exception:  # the JVM may be gone already; its folders are then left
        _folders.clear()


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Parquet rather than ``checkpoint()``: later passes then read only the
    columns they use.  The table lives until :func:`release` or the end of the
    process.
    """
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
