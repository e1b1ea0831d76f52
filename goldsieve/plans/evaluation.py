"""Grading a model by majority vote over its sampled completions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.functions.numbers import is_correct
from goldsieve.functions.text import strip
from goldsieve.operators.completions import require_unique
from goldsieve.operators.reports import run_report
from goldsieve.operators.voting import vote_tagged


class Evaluated(NamedTuple):
    results: DataFrame
    accuracy: DataFrame


def evaluate(problems: DataFrame, completions: DataFrame, split: str = "test") -> Evaluated:
    """``problems``: ``problem_id, id, question, gold``, all of them: one without
    a valid completion is wrong, not left out.
    ``completions``: ``problem_id, sample_no, text``.
    """
    require_unique(problems, "problem_id")
    votes = vote_tagged(completions.withColumn("text", strip("text")))
    answer, gold = F.col("answer"), F.col("gold")
    asked = problems.select("problem_id", "id", "question", "gold")
    results = asked.join(votes, "problem_id", "left").select(
        F.col("id").cast("bigint").alias("id"),
        F.lit(split).alias("split"),
        "question",
        gold.alias("golden_answer"),
        F.col("text").alias("assistant_answer"),
        "answer",
        F.coalesce((answer != "") & is_correct(gold, answer), F.lit(False)).alias(
            "exact_match"
        ),
    )
    return Evaluated(results, run_report(results, flag="exact_match"))
