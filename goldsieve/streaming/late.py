"""Problems that come after their completions.

A completion whose problem is not known yet is parked: the stream writes it with the
verdict ``no_problem``.  :func:`regrade` joins what is parked with the problems known now and
writes the new verdicts in a pass of its own.  The stream's files are never changed.
Which parked rows a pass took is told by their micro-batch and problem, so
:func:`all_verdicts` gives each completion one verdict, the last.

A pass counts once its ``_SUCCESS`` mark is there.  One that is cut off is replaced by
the next, which takes the same number, and its rows stay parked until then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldsieve import schemas
from goldsieve.operators.completions import require_unique
from goldsieve.plans.curation import NO_PROBLEM, judge, kept_records
from goldsieve.streaming.sinks import complete

KEPT = "kept"
_VERDICT = "verdict"
_TAKEN = ["batch_id", "problem_id"]


def _stream_rows(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).withColumn("batch_id", F.col("batch_id").cast("bigint"))


def _passes(spark: SparkSession, sink: str, late: str) -> DataFrame | None:
    """Rows of all whole passes, in the layout of the stream's own; a pass may be empty."""
    found = complete(spark, late, "pass")
    if not found:
        return None
    paths = [f"{late}/pass={number}" for number in found]
    layout = _stream_rows(spark, sink).schema
    return spark.read.schema(layout).option("basePath", late).parquet(*paths).drop("pass")


def parked(spark: SparkSession, sink: str, late: str) -> DataFrame:
    """Completions, with their ``batch_id``, that no problem has been found for so far."""
    rows = _stream_rows(spark, sink).where(F.col(_VERDICT) == NO_PROBLEM)
    graded = _passes(spark, sink, late)
    if graded is not None:
        rows = rows.join(graded.select(*_TAKEN).distinct(), _TAKEN, "left_anti")
    return rows.select("batch_id", *schemas.COMPLETION.fieldNames())


def regrade(spark: SparkSession, sink: str, late: str, prompts: DataFrame) -> int:
    """Grade the parked completions whose problem is in ``prompts``; the number of the pass.

    ``prompts`` has the columns that the stream was graded with.  Only parked rows are
    read and joined, and those that find no problem stay as they are.  Not to be run beside the stream's own query or another pass.
    """
    require_unique(prompts, "problem_id")
    number = max(complete(spark, late, "pass"), default=0) + 1
    waiting = parked(spark, sink, late).join(prompts.select("problem_id"), "problem_id", "left_semi")
    graded = judge(waiting, prompts).withColumn(_VERDICT, F.coalesce("reject_reason", F.lit(KEPT)))
    (
        graded.drop("reject_reason", "kept")
        .write.mode("overwrite")
        .partitionBy(_VERDICT)
        .parquet(f"{late}/pass={number}")
    )
    return number


def all_verdicts(spark: SparkSession, sink: str, late: str) -> DataFrame:
    """``problem_id, sample_no, text, batch_id, verdict``: each completion once."""
    names = [*schemas.COMPLETION.fieldNames(), "batch_id", _VERDICT]
    rows = _stream_rows(spark, sink).select(*names)
    graded = _passes(spark, sink, late)
    if graded is None:
        return rows
    waiting = F.col(_VERDICT) == NO_PROBLEM
    left = rows.where(waiting).join(graded.select(*_TAKEN).distinct(), _TAKEN, "left_anti")
    return rows.where(~waiting).unionByName(left.select(*names)).unionByName(graded.select(*names))


def all_kept(spark: SparkSession, sink: str, late: str, split: str = "train") -> DataFrame:
    """Kept records of the stream and of all passes."""
    rows = _stream_rows(spark, sink)
    graded = _passes(spark, sink, late)
    if graded is not None:
        rows = rows.unionByName(graded)
    return kept_records(rows.where(F.col(_VERDICT) == KEPT).withColumn("kept", F.lit(True)), split)
