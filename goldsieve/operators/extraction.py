"""Answers of whole completions, by tag or by phrase."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from goldsieve.functions.answers import phrased_answer, tagged_answer


def extract_tagged(df: DataFrame, text: str = "text", into: str = "answer") -> DataFrame:
    return df.withColumn(into, tagged_answer(F.col(text)))


def extract_phrased(df: DataFrame, text: str = "text", into: str = "answer") -> DataFrame:
    return df.withColumn(into, phrased_answer(F.col(text)))
