"""Curating completions as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from goldsieve.operators.completions import require_unique
from goldsieve.operators.numbering import running_total
from goldsieve.operators.reports import percent
from goldsieve.plans.curation import judge, kept_records
from goldsieve.streaming.sinks import batch_sink, claim, has_files, sink_rows

_VERDICT = "verdict"
_KEPT = "kept"


def curate_stream(
    completions: DataFrame,
    prompts: DataFrame,
    sink: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Grade a stream against a static problem table and write every verdict.

    Each micro-batch fills its own ``batch_id=`` folder under ``sink``, which a
    replay overwrites, so nothing is written twice.  A sink belongs to one
    checkpoint: filled by another, its batches may be cut otherwise, and it is
    refused.  Rows lie apart by verdict:
    kept rows and each kind of reject come out of a single pass.  The problem
    table is read for every micro-batch; the larger it is, the larger those
    should be.
    """
    require_unique(prompts, "problem_id")
    spark = prompts.sparkSession
    claim(spark, sink, checkpoint)
    graded = judge(completions, prompts).withColumn(
        _VERDICT, F.coalesce("reject_reason", F.lit(_KEPT))
    )
    # An empty first part fixes the layout, so a stream without rows can be read.
    if not has_files(spark, sink):
        layout = graded.drop("reject_reason", "kept").schema
        empty = spark.createDataFrame([], layout).withColumn("batch_id", F.lit(-1))
        empty.drop("batch_id", _VERDICT).write.parquet(f"{sink}/batch_id=-1/{_VERDICT}={_KEPT}")

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.drop("reject_reason", "kept")
            .write.mode("overwrite")
            .partitionBy(_VERDICT)
            .parquet(f"{sink}/batch_id={batch_id}")
        )

    return (
        graded.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _verdicts(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink)


def streamed_kept(spark: SparkSession, sink: str, split: str = "train") -> DataFrame:
    """Kept records of all micro-batches; reads only the kept folders."""
    rows = _verdicts(spark, sink).where(F.col(_VERDICT) == _KEPT)
    return kept_records(rows.withColumn("kept", F.lit(True)), split)


def batch_metrics(spark: SparkSession, sink: str) -> DataFrame:
    """Kept and total per micro-batch, with running counts and success rate.

    Needs only the folder names and row counts.  Micro-batches without rows
    have no line.
    """
    hits = F.col(_VERDICT) == _KEPT
    counted = (
        _verdicts(spark, sink)
        .groupBy(F.col("batch_id").cast("bigint").alias("batch_id"))
        .agg(F.count_if(hits).alias("kept"), F.count("*").alias("total"))
    )
    rate = percent(F.col("running_kept"), F.col("running_total"))
    return running_total(
        counted, "batch_id", {"running_kept": "kept", "running_total": "total"}
    ).withColumn("running_pct", rate)


def running_success(graded: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per key over a stream of :func:`judge` output.

    For ``update`` or ``complete`` mode; the state is one row per key.
    """
    kept = F.sum(F.col("kept").cast(T.LongType()))
    return graded.groupBy(*by).agg(
        kept.alias("kept"),
        F.count("*").alias("total"),
        F.try_divide(F.lit(100.0) * kept, F.count("*")).alias("success_pct"),
    )


def running_success_stream(
    graded: DataFrame,
    by: Sequence[str],
    sink: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep :func:`running_success` of a graded stream in an upsert table.

    The counts live in Spark's state store, one row per key, so no batch reads an
    earlier one.  A micro-batch writes the keys that it changed under its own id, and a
    replay replaces them; :func:`latest_success` takes each key's last row.
    """
    return batch_sink(running_success(graded, by), sink, checkpoint, trigger, mode="update")


def latest_success(spark: SparkSession, sink: str, by: Sequence[str]) -> DataFrame:
    """The last counts of each key, as of the last whole micro-batch."""
    rows = sink_rows(spark, sink)
    last = F.max_by(F.struct("kept", "total", "success_pct"), "batch_id")
    return rows.groupBy(*by).agg(last.alias("last")).select(*by, "last.*")
