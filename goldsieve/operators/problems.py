"""Problem sets: adapter rows, templates, and rejects."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.functions.answers import after_last_marker, final_answer, rationale
from goldsieve.functions.formats import GOLD_MARKER
from goldsieve.functions.text import normalize_text
from goldsieve.operators.numbering import with_row_no

# Task name and reject reason.
TASK_TYPE = "math"
NO_MARKER = "no_marker"


class Templates(NamedTuple):
    rows: DataFrame
    rejects: DataFrame


def ingest_problems(
    df: DataFrame, dataset: str, split: str, order_by: Sequence[str]
) -> DataFrame:
    """Adapter rows ``id, task_type, question, gold_answer``.

    Ids are ``dataset/split/n`` with n the 0-based position by ``order_by``,
    which must be unique.  A ``row_no`` already on ``df`` is used as it is.
    """
    numbered = df if "row_no" in df.columns else with_row_no(df, order_by)
    return numbered.select(
        F.concat_ws("/", F.lit(dataset), F.lit(split), F.col("row_no")).alias("id"),
        F.lit(TASK_TYPE).alias("task_type"),
        "question",
        after_last_marker(F.col("answer")).alias("gold_answer"),
    )


def template_problems(df: DataFrame, carry: Sequence[str] = ()) -> Templates:
    """Template rows of raw problems; solutions without a marker are rejects.

    ``carry`` names columns, such as a key, to keep in front.
    """
    # Whether there is a marker shows in the raw text; filtering on that, not on
    # the extracted answer, keeps the extraction out of the filter.
    marked = F.coalesce(F.contains("answer", F.lit(GOLD_MARKER)), F.lit(False))

    def normalized(rows: DataFrame) -> DataFrame:
        return rows.select(
            *carry,
            normalize_text("question").alias("question"),
            normalize_text("answer").alias("_solution"),
        )

    solution, gold = F.col("_solution"), F.col("golden_answer")
    read = normalized(df.where(marked)).withColumn("golden_answer", final_answer(solution))
    rows = read.select(
        *carry,
        "question",
        F.concat(
            rationale(solution, gold), F.lit("\n<answer>"), gold, F.lit("</answer>")
        ).alias("assistant_target"),
        "golden_answer",
    )
    rejects = normalized(df.where(~marked)).select(
        *carry,
        "question",
        solution.alias("answer"),
        F.lit(NO_MARKER).alias("reject_reason"),
    )
    return Templates(rows, rejects)


def template_kept(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Template rows of kept completions: the completion is the target."""
    return df.select(
        *carry,
        normalize_text("question").alias("question"),
        normalize_text("assistant_answer").alias("assistant_target"),
        normalize_text("gold_answer").alias("golden_answer"),
    )
