"""Grading against gold, and the length filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldsieve.functions.numbers import is_correct

# Inclusive length bounds in characters.
SHORTEST, LONGEST = 30, 900


def grade(
    df: DataFrame, gold: str = "gold", predicted: str = "answer", into: str = "is_correct"
) -> DataFrame:
    return df.withColumn(into, is_correct(F.col(gold), F.col(predicted)))


def has_length(value: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    return F.coalesce(F.length(value).between(shortest, longest), F.lit(False))


def within_length(
    df: DataFrame, column: str, shortest: int = SHORTEST, longest: int = LONGEST
) -> DataFrame:
    return df.where(has_length(F.col(column), shortest, longest))
