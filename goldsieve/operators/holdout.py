"""Exact, seeded hold-out without sorting the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of the first histogram: at most 16^5 = 1,048,576 rows in it.
_PREFIX = 5


def split_holdout(
    df: DataFrame, key: str, fraction: float = 0.1, seed: int = 42
) -> DataFrame:
    """Flag the ``ceil(fraction * n)`` rows with the smallest seeded key hash.

    ``key`` must be unique (``with_row_no`` makes one); rows sharing a key stay
    on one side.  Counts per hash prefix find the prefix the cut falls into,
    counts inside that prefix find the cut itself.  Both passes read only
    ``key``, and the rows are then compared with one scalar: they never move.
    ``df`` runs three times in all, so it should be a table.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    hashes = df.select(digest.alias("_hash"))
    prefix = F.substring("_hash", 1, _PREFIX)

    counts = hashes.groupBy(prefix.alias("_prefix")).agg(F.count("*").alias("_n"))
    everything = Window.partitionBy()
    crossing = counts.select(
        "_prefix",
        F.sum("_n").over(Window.orderBy("_prefix")).alias("_upto"),
        (F.sum("_n").over(Window.orderBy("_prefix")) - F.col("_n")).alias("_before"),
        F.ceil(F.lit(float(fraction)) * F.sum("_n").over(everything)).alias("_wanted"),
    ).where((F.col("_before") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_upto")))
    edge = crossing.select(
        F.struct("_prefix", (F.col("_wanted") - F.col("_before")).alias("_left"))
    ).scalar()

    cut = (
        hashes.where(prefix == edge["_prefix"])
        .groupBy("_hash")
        .agg(F.count("*").alias("_n"))
        .select("_hash", F.sum("_n").over(Window.orderBy("_hash")).alias("_upto"))
        .where(F.col("_upto") >= edge["_left"])
        .agg(F.min("_hash").alias("_cut"))
    )
    return df.withColumn("is_validation", F.coalesce(digest <= cut.scalar(), F.lit(False)))
