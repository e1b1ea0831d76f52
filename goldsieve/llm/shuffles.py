"""Disk of steps that are over, and memory of batches on their way to Python."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more.

    They go when the driver collects its garbage, which an idle driver puts off
    for as long as half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound what a task hands to Python at once by its bytes.

    The default of 64 MB is held several times over: in the executor's buffers, which
    Spark does not give back, on the wire, and in the worker.  The setting stays for
    later plans of the session; it changes no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
