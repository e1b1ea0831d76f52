"""Votes and best of n over completions as they arrive.

Each micro-batch is reduced to one row per problem and answer before it is written:
the votes and the first sample, or the best rank, with the one text that has it.  Such rows
merge: votes add up, the earlier sample or the better rank stays.  What an answer is
worth is therefore never read from an old completion again, and the outcome after any
batch is that of the batch operator over all completions so far, however they were cut
into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from goldsieve.functions.numbers import comparable, same_answer
from goldsieve.operators.extraction import extract_tagged
from goldsieve.operators.selection import ranked
from goldsieve.streaming.sinks import batch_sink, fold, sink_rows

_BY = ("problem_id", "answer")


def _tallied(batch: DataFrame) -> DataFrame:
    """``problem_id, answer, votes, first``; an invalid answer is null and has no ``first``."""
    first = F.when(F.col("answer").isNotNull(), F.struct("sample_no", "text"))
    return extract_tagged(batch).groupBy(*_BY).agg(
        F.count("*").alias("votes"), F.min(first).alias("first")
    )


def _merged_votes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_BY).agg(F.sum("votes").alias("votes"), F.min("first").alias("first"))


def vote_stream(
    completions: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Gather tagged votes of a stream of ``problem_id, sample_no, text``."""
    return batch_sink(completions, sink, checkpoint, trigger, each=_tallied)


def fold_votes(spark: SparkSession, sink: str) -> int:
    return fold(spark, sink, _merged_votes)


def streamed_votes(spark: SparkSession, sink: str) -> DataFrame:
    """``problem_id, answer, text`` as :func:`vote_tagged` finds over all completions so far.

    Votes are compared without texts; the winners' are fetched afterwards.
    """
    rows = sink_rows(spark, sink).where(F.col("answer").isNotNull())
    counted = rows.groupBy(*_BY).agg(
        F.sum("votes").alias("votes"), F.min("first.sample_no").alias("sample_no")
    )
    rank = F.struct((-F.col("votes")).alias("votes"), "sample_no", "answer")
    winners = counted.groupBy("problem_id").agg(F.min(rank).alias("best"))
    wanted = winners.select("problem_id", "best.answer", "best.sample_no")
    texts = rows.select(*_BY, "first.sample_no", "first.text")
    found = wanted.join(texts, ["problem_id", "answer", "sample_no"])
    return found.groupBy(*_BY).agg(F.min("text").alias("text"))


def _ranked_best(batch: DataFrame) -> DataFrame:
    """``problem_id, answer, best``: the best rank, as a negative number, and its text."""
    best = F.when(
        F.col("_rank").isNotNull(), F.struct((-F.col("_rank")).alias("order"), "text", "parsed")
    )
    rows = ranked(batch)
    return rows.groupBy("problem_id", F.col("_answer").alias("answer")).agg(F.min(best).alias("best"))


def _merged_best(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_BY).agg(F.min("best").alias("best"))


def best_stream(
    completions: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Gather the best completion of each distinct answer; no gold is needed yet."""
    return batch_sink(completions, sink, checkpoint, trigger, each=_ranked_best)


def fold_best(spark: SparkSession, sink: str) -> int:
    return fold(spark, sink, _merged_best)


def streamed_best(spark: SparkSession, sink: str, problems: DataFrame) -> DataFrame:
    """What :func:`best_of_n` finds over all completions so far; ``problems`` as of now."""
    rows = sink_rows(spark, sink).where(F.col("answer").isNotNull())
    per_answer = rows.groupBy(*_BY).agg(F.min("best.order").alias("order"))
    gold = problems.where(F.col("gold") != "").select(
        "problem_id", comparable(F.col("gold")).alias("wanted")
    )
    right = (
        per_answer.withColumn("got", comparable(F.col("answer")))
        .join(gold, "problem_id")
        .where(same_answer(F.col("wanted"), F.col("got")))
        .groupBy("problem_id")
        .agg(F.min(F.struct("order", "answer")).alias("first"))
        .select("problem_id", "first.order", "first.answer")
    )
    texts = rows.select(*_BY, "best.order", "best")
    return (
        right.join(texts, ["problem_id", "answer", "order"])
        .groupBy("problem_id")
        .agg(F.min("best").alias("best"))
        .select(
            "problem_id",
            *(f"best.parsed.{name}" for name in ("reason", "answer", "closing")),
            "best.text",
        )
    )
