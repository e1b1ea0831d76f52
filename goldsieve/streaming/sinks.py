"""A sink with one folder per micro-batch, and the folding of what has gathered in it.

``<sink>/batches/batch_id=N`` holds what micro-batch N wrote; a replay replaces it, so
nothing is written twice.  :func:`fold` merges all whole batches into
``<sink>/folded/upto=N``; readers then take the last folded table and the batches after
it.  A folded table counts once its ``_SUCCESS`` mark is there, so a fold that is cut off
changes nothing, and the next one replaces it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_NONE = -2
_LAYOUT = -1


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists and is not empty, on any file system Spark reads."""
    folder, system = _folder(spark, path)
    return bool(system.exists(folder)) and len(system.listStatus(folder)) > 0


def numbered(spark: SparkSession, parent: str, level: str) -> list[int]:
    """Numbers of the folders ``<parent>/<level>=N``, written to their end or not."""
    folder, system = _folder(spark, parent)
    if not system.exists(folder):
        return []
    names = (status.getPath().getName() for status in system.listStatus(folder))
    return sorted(int(name.split("=")[1]) for name in names if name.startswith(f"{level}="))


def complete(spark: SparkSession, parent: str, level: str) -> list[int]:
    """Numbers of the folders ``<parent>/<level>=N`` whose write came to its end."""
    system = _folder(spark, parent)[1]
    return [
        number
        for number in numbered(spark, parent, level)
        if system.exists(_folder(spark, f"{parent}/{level}={number}/_SUCCESS")[0])
    ]


def delete(spark: SparkSession, path: str) -> None:
    folder, system = _folder(spark, path)
    system.delete(folder, True)


def claim(spark: SparkSession, sink: str, checkpoint: str) -> None:
    """Refuse a sink that another checkpoint filled: its batches may be cut otherwise."""
    if has_files(spark, sink) and not has_files(spark, f"{checkpoint}/commits"):
        raise ValueError(f"{sink} holds the batches of another checkpoint than {checkpoint}")


def batch_sink(
    rows: DataFrame,
    sink: str,
    checkpoint: str,
    trigger: dict | None = None,
    mode: str = "append",
    each: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Start writing a stream to ``sink``; ``each`` reduces a micro-batch before it is written."""
    spark = rows.sparkSession
    claim(spark, sink, checkpoint)
    if not has_files(spark, sink):
        # An empty first part fixes the layout, so a stream without rows can be read.
        empty = spark.createDataFrame([], rows.schema)
        (each(empty) if each else empty).write.parquet(f"{sink}/batches/batch_id={_LAYOUT}")

    def write(batch: DataFrame, batch_id: int) -> None:
        reduced = each(batch) if each else batch
        reduced.write.mode("overwrite").parquet(f"{sink}/batches/batch_id={batch_id}")

    return (
        rows.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _folded_upto(spark: SparkSession, sink: str) -> int:
    return max(complete(spark, f"{sink}/folded", "upto"), default=_NONE)


def sink_rows(spark: SparkSession, sink: str) -> DataFrame:
    """All rows of a sink with their ``batch_id``; folded rows bear the last one folded."""
    upto = _folded_upto(spark, sink)
    batch_id = F.col("batch_id").cast("bigint").alias("batch_id")
    rows = spark.read.parquet(f"{sink}/batches")
    names = [name for name in rows.columns if name != "batch_id"]
    rows = rows.where(F.col("batch_id") > upto).select(*names, batch_id)
    if upto == _NONE:
        return rows
    folded = spark.read.schema(rows.drop("batch_id").schema).parquet(f"{sink}/folded/upto={upto}")
    return rows.unionByName(folded.withColumn("batch_id", F.lit(upto).cast("bigint")))


def fold(spark: SparkSession, sink: str, merge: Callable[[DataFrame], DataFrame]) -> int:
    """Merge all whole batches into one table; the number of the last one.

    ``merge`` maps rows to rows of the same columns, and merging merged rows with
    others must come to the same as merging all at once.  Not to be run beside
    another fold of the same sink.
    """
    last = max(complete(spark, f"{sink}/batches", "batch_id"), default=_LAYOUT)
    if last > _folded_upto(spark, sink):
        rows = sink_rows(spark, sink).where(F.col("batch_id") <= last).drop("batch_id")
        merge(rows).write.mode("overwrite").parquet(f"{sink}/folded/upto={last}")
    return last
