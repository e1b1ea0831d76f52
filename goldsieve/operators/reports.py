"""Success per batch, per run and overall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldsieve.operators.numbering import running_total


def _counted(flag: str) -> tuple[Column, Column]:
    hits = F.count_if(F.coalesce(F.col(flag), F.lit(False)))
    return hits.alias("kept"), F.count("*").alias("total")


def as_printed(value: Column, digits: int) -> Column:
    """``value`` >= 0 rounded as a float is printed: its exact binary value, half to even.

    ``format_number`` does so, except below the last digit, where it reads the
    shortest decimal; there the double nearest to the tie decides.
    """
    unit = 10.0**-digits
    tie = unit / 2
    goes_up = value >= tie if float(f"{tie:.{digits}f}") else value > tie
    small = F.when(goes_up, unit).otherwise(0.0)
    printed = F.regexp_replace(F.format_number(value, digits), ",", "").cast("double")
    return F.when(value < unit, small).otherwise(printed)


def percent(kept: Column, total: Column) -> Column:
    return as_printed(F.try_divide(F.lit(100.0) * kept, total), 1)


def batch_report(df: DataFrame, batch_size: int, flag: str = "kept") -> DataFrame:
    """Counts per batch of consecutive ``row_no``, with running totals.

    ``batch_no`` counts from 1; the last batch may be short.  ``flag`` is the
    boolean column of rows that count as a success.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    batches = (
        df.groupBy(F.expr(f"row_no div {int(batch_size)} + 1").alias("batch_no"))
        .agg(*_counted(flag))
        .withColumn("success_pct", percent(F.col("kept"), F.col("total")))
    )
    return running_total(
        batches, "batch_no", {"running_kept": "kept", "running_total": "total"}
    )


def run_report(df: DataFrame, by: Sequence[str] = (), flag: str = "kept") -> DataFrame:
    """Kept, total, percentage and rate; with ``by``, also every subtotal.

    Rows are counted once per full key, and only those counts are rolled up.
    A subtotal has null in the columns it sums over, and ``level`` tells how
    many of them there are.
    """
    counted = df.groupBy(*by).agg(*_counted(flag))
    if by:
        counted = counted.rollup(*by).agg(
            F.sum("kept").alias("kept"),
            F.sum("total").alias("total"),
            F.bit_count(F.grouping_id()).cast("int").alias("level"),
        )
    return counted.withColumns(
        {
            "success_pct": percent(F.col("kept"), F.col("total")),
            "rate": as_printed(F.try_divide(F.col("kept"), F.col("total")), 3),
        }
    )


def curation_report(graded: DataFrame, prompts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`run_report` of graded completions, over all problems.

    ``problems`` counts those asked, ``without_completion`` those that nothing
    came back for, and ``kept_per_problem_pct`` is kept over all problems, so a
    missing completion lowers it.  ``by`` are columns of ``prompts``.  Completions
    of unknown problems belong to no run and do not count.
    """
    known = graded.where(F.coalesce(F.col("reject_reason") != "no_problem", F.lit(True)))
    report = run_report(known, by)
    answered = graded.select("problem_id").distinct().withColumn("_answered", F.lit(1))
    asked = prompts.select("problem_id", *by).join(answered, "problem_id", "left")
    counts = F.count("*").alias("problems"), F.count_if(F.col("_answered").isNull()).alias("without_completion")
    if by:
        asked = asked.rollup(*by).agg(*counts, F.bit_count(F.grouping_id()).cast("int").alias("level"))
    else:
        asked = asked.agg(*counts)
    keys = [*by, "level"] if by else []
    same = F.lit(True)
    for name in keys:
        same = same & asked[name].eqNullSafe(report[name])
    # One row per run on both sides.
    joined = asked.join(report, same, "left")
    kept = F.coalesce(report["kept"], F.lit(0))
    return joined.select(
        *(asked[name] for name in keys),
        "problems",
        "without_completion",
        kept.alias("kept"),
        F.coalesce(report["total"], F.lit(0)).alias("total"),
        "success_pct",
        "rate",
        percent(kept, F.col("problems")).alias("kept_per_problem_pct"),
    )
