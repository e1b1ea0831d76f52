"""Majority votes over the sampled completions of a problem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.operators.extraction import extract_phrased, extract_tagged


def _tally(answers: DataFrame) -> DataFrame:
    """Winner of each problem: most votes, then seen first.

    Votes are counted per answer before they are compared per problem, both
    times with a map-side step, so a problem or an answer with a large share of
    all samples reaches each later task as one row.  Invalid (null) answers
    have no rank and drop out at the end: a filter on them would be pushed under
    the extraction and run it again.
    """
    votes = answers.groupBy("problem_id", "answer").agg(
        F.count("*").alias("_votes"), F.min("sample_no").alias("_first")
    )
    rank = F.when(
        F.col("answer").isNotNull(), F.struct((-F.col("_votes")).alias("votes"), "_first")
    )
    winner = F.min_by(F.struct("answer", "_first"), rank)
    return (
        votes.groupBy("problem_id")
        .agg(winner.alias("_winner"))
        .where(F.col("_winner").isNotNull())
        .select(
            "problem_id",
            F.col("_winner.answer").alias("answer"),
            F.col("_winner._first").alias("sample_no"),
        )
    )


def vote_phrased(df: DataFrame) -> DataFrame:
    """Winning phrased answer per problem: ``problem_id, answer``."""
    answers = extract_phrased(df).select("problem_id", "sample_no", "answer")
    return _tally(answers).select("problem_id", "answer")


def vote_tagged(df: DataFrame) -> DataFrame:
    """Winning tagged answer and the first whole text that gave it.

    Only answers travel through the vote.  The text is fetched afterwards, one
    per problem.  ``df`` runs twice, so it should be a table.
    """
    answers = extract_tagged(df).select("problem_id", "sample_no", "answer")
    winners = _tally(answers)
    # Only texts with a winner's key are read again; null, not a filter, for other
    # texts of that key: a filter would be pushed into the join and read all of them.
    keyed = winners.join(df.select("problem_id", "sample_no", "text"), ["problem_id", "sample_no"])
    first = F.when(F.col("_own") == F.col("answer"), F.col("text"))
    found = extract_tagged(keyed, into="_own")
    return found.groupBy("problem_id", "answer").agg(F.min(first).alias("text"))
