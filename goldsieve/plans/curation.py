"""Rejection sampling: keep the completions whose answer equals the gold."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.functions.numbers import comparable, same_answer
from goldsieve.operators.completions import attach_completions, require_unique
from goldsieve.operators.parsing import parse_strict

# Why a completion was not kept.
NO_PROBLEM, UNPARSED, EMPTY_ANSWER = "no_problem", "unparsed", "empty_answer"
NO_GOLD, WRONG_ANSWER = "no_gold", "wrong_answer"


# What the outcome takes from the problem, not from the completion.
_ASKED = ("gold", "id", "question")


def _free(name: str, taken: set[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name in taken:
        name += "_"
    return name


class Curated(NamedTuple):
    kept: DataFrame
    rejects: DataFrame
    graded: DataFrame
    outstanding: DataFrame


def judge(completions: DataFrame, prompts: DataFrame) -> DataFrame:
    """Join gold to completions and say for each why it is rejected, if it is.

    Every completion comes back: one whose ``problem_id`` is unknown or null is
    a reject as well, and so is one whose problem has no gold.  ``prompts`` has
    one row per problem (see :func:`require_unique`).

    ``gold``, ``id`` and ``question`` come from ``prompts``; of any other column that
    both inputs have, the completion's stays.  A column named ``parsed``,
    ``reject_reason`` or ``kept`` gives way to the result; other names are free.

    Works the same on a stream of completions.  Parsing and reading numbers
    come before the join: a problem with very many completions then costs the
    task that joins them no more than a comparison each, and a report on the
    outcome does not shuffle the parsed text.
    """
    answer = F.col("parsed.answer")
    asked_for = {name for name in _ASKED if name in prompts.columns}
    own = {*completions.columns, "parsed", "reject_reason", "kept"} - asked_for - {"problem_id"}
    prompts = prompts.drop(*own)
    taken = {*completions.columns, *prompts.columns}
    flaw, got, wanted, known = (_free(name, taken) for name in ("_flaw", "_got", "_wanted", "_known"))
    parsed = parse_strict(completions.drop(*asked_for)).withColumns(
        {
            flaw: F.when(F.col("parsed").isNull(), UNPARSED).when(answer == "", EMPTY_ANSWER),
            got: comparable(answer),
        }
    )
    asked = prompts.withColumns({wanted: comparable(F.col("gold")), known: F.lit(True)})
    same = F.coalesce(same_answer(F.col(wanted), F.col(got)), F.lit(False))
    reason = (
        F.when(F.col(known).isNull(), NO_PROBLEM)
        .when(F.col(flaw).isNotNull(), F.col(flaw))
        .when(F.col("gold").isNull(), NO_GOLD)
        .when(~same, WRONG_ANSWER)
    )
    # The adaptive join can split a heavy problem on this outer join's kept side.
    return (
        parsed.join(asked, "problem_id", "left")
        .withColumn("reject_reason", reason)
        .withColumn("kept", F.col("reject_reason").isNull())
        .drop(flaw, got, wanted, known)
    )


def kept_records(graded: DataFrame, split: str) -> DataFrame:
    """Kept rows in the record layout of the kept file."""
    return graded.where("kept").select(
        F.col("id").cast("bigint").alias("id"),
        F.lit(split).alias("split"),
        "question",
        F.col("gold").alias("gold_answer"),
        F.col("parsed.reason").alias("trip_before"),
        F.col("parsed.answer").alias("answer"),
        F.col("parsed.closing").alias("end"),
        F.col("text").alias("assistant_answer"),
    )


def rejected(graded: DataFrame) -> DataFrame:
    """Rows not kept, with their ``reject_reason``."""
    return graded.where(~F.col("kept")).drop("parsed", "kept")


def curate(prompts: DataFrame, completions: DataFrame, split: str = "train") -> Curated:
    """``prompts``: ``problem_id, id, question, gold``, one row per problem.
    ``completions``: ``problem_id, text``, any number per problem.

    ``kept``, ``rejects`` and ``graded`` share one plan.  Write ``graded`` once
    and select from it if more than one of them is needed.  ``outstanding`` are
    the problems without a completion.
    """
    require_unique(prompts, "problem_id")
    graded = judge(completions, prompts)
    return Curated(
        kept=kept_records(graded, split),
        rejects=rejected(graded),
        graded=graded,
        outstanding=attach_completions(prompts, completions).outstanding,
    )
