"""A bounded sample of labelled documents, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text, modulo 4, is 2; null keys are not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``doc_id, text, quality`` of at most ``most`` labelled keys that are not held out.

    The keys with the least hash are taken, so the sample is fixed and, at most
    ``most`` keys and labels, small enough to send to every task.  Of several
    labels of a key the least holds; null keys and labels are ignored.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
        .select(F.col("doc_id").alias("_labelled"), "quality")
    )
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled")).drop("_labelled")
