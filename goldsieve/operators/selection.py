"""Best of n: the longest correct completion of each problem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.functions.numbers import comparable, same_answer
from goldsieve.operators.grading import has_length
from goldsieve.operators.parsing import parse_lenient


# A rank is twice the score, then the sample number from the last possible one down.
_SAMPLES = 1 << 32
_LAST = (1 << 31) - 1


def best_of_n(completions: DataFrame, problems: DataFrame) -> DataFrame:
    """One row ``problem_id, reason, answer, closing, text`` per solved problem.

    ``completions``: ``problem_id, sample_no, text``; ``problems``:
    ``problem_id, gold``.  A sample counts if it parses leniently, its reasoning
    and its closing keep the length bounds, and it is correct.  The highest
    ``len(reason) + 0.5 * len(closing)`` wins, the earliest sample on a tie.

    Whether a sample is correct depends on its answer alone, so only the best
    rank of each distinct answer meets the gold: score and sample number in one
    number.  That maximum is taken map-side first, and a problem with very many
    samples sends few rows, none of them a text.  The winners' texts are fetched
    and parsed afterwards.  ``completions`` runs twice, so it should be a table.
    If a sample number repeats, the least text that has the rank counts.
    """
    scored = ranked(completions)
    per_answer = scored.groupBy("problem_id", "_answer").agg(F.max("_rank").alias("_rank"))
    gold = problems.where(F.col("gold") != "").select(
        "problem_id", comparable(F.col("gold")).alias("_wanted")
    )
    best = (
        per_answer.where(F.col("_rank").isNotNull())
        .withColumn("_got", comparable(F.col("_answer")))
        .join(gold, "problem_id")
        .where(same_answer(F.col("_wanted"), F.col("_got")))
        .groupBy("problem_id")
        .agg(F.max("_rank").alias("_rank"))
    )
    winners = best.select(
        "problem_id", (_LAST - F.col("_rank") % _SAMPLES).cast("int").alias("sample_no"),
        F.col("_rank").alias("_won"),
    )
    texts = winners.join(completions.select("problem_id", "sample_no", "text"), ["problem_id", "sample_no"])
    # No filter on the rank: it would be pushed into the join and parse there again.
    # One row per problem reaches this sort; the text comes first in the order.
    won = F.when(F.col("_own") == F.col("_won"), F.struct("text", "parsed"))
    return ranked(texts, "_own").groupBy("problem_id").agg(F.min(won).alias("_best")).select(
        "problem_id",
        *(f"_best.parsed.{name}" for name in ("reason", "answer", "closing")),
        "_best.text",
    )


def ranked(samples: DataFrame, into: str = "_rank") -> DataFrame:
    """Add ``parsed``, ``_answer`` and the rank of a sample that counts; the last two null otherwise.

    Ranks of samples that do not count stay null instead of being filtered: a
    filter would be pushed under the parse and run it again.
    """
    reason, answer, closing = (
        F.col(f"parsed.{name}") for name in ("reason", "answer", "closing")
    )
    counts = (answer != "") & has_length(reason) & has_length(closing)
    halves = (2 * F.length(reason) + F.length(closing)).cast("bigint")
    rank = halves * _SAMPLES + (_LAST - F.col("sample_no"))
    return (
        parse_lenient(samples)
        .withColumn("_answer", F.when(counts, answer))
        .withColumn(into, F.when(counts, rank))
    )
