"""Fanning prompts out and joining completions back."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Attached(NamedTuple):
    rows: DataFrame
    outstanding: DataFrame
    orphans: DataFrame
    repeated: DataFrame


def fan_out(df: DataFrame, n: int) -> DataFrame:
    """``n`` copies of each row, numbered 1 to n in ``sample_no``.

    Fan out keys, not texts: join the prompt back where it is needed.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    return df.withColumn("sample_no", F.explode(F.sequence(F.lit(1), F.lit(n))))


def require_unique(df: DataFrame, *keys: str) -> None:
    """Raise if a key occurs more than once, which would multiply joined rows.

    Runs one aggregate over the keys alone.
    """
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if repeated:
        found = ", ".join(str(tuple(row)[:-1]) for row in repeated)
        raise ValueError(f"{', '.join(keys)} must be unique; repeated: {found}")


def attach_completions(
    prompts: DataFrame,
    completions: DataFrame,
    on: Sequence[str] = ("problem_id",),
    how: str = "inner",
) -> Attached:
    """Join completions to prompts by key.

    ``outstanding`` are prompts without a completion, ``orphans`` completions
    without a prompt, and ``repeated`` keys that occur more than once among the
    prompts, which would multiply rows.  Each is computed only if it is used.
    ``how="left"`` keeps prompts without a completion in ``rows``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    keys = list(on)
    answered = completions.select(*keys).distinct()
    asked = prompts.select(*keys).distinct()
    outstanding = prompts.join(answered, keys, "left_anti")
    rows = completions.join(prompts, keys)
    if how == "left":
        # One problem may own many completions.  The adaptive join can split
        # such a partition in an inner join, but not on the side that an outer
        # join fills with nulls.
        rows = rows.unionByName(outstanding, allowMissingColumns=True)
    return Attached(
        rows=rows,
        outstanding=outstanding,
        orphans=completions.join(asked, keys, "left_anti"),
        repeated=prompts.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"),
    )
