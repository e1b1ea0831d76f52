"""Row numbers that stay when rows are appended.

``<store>/appends/append_id=N`` holds the keys that append N saw first, with their
numbers.  An append counts once its ``_SUCCESS`` mark is there, so one that was cut off is
simply run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldsieve.durable import written
from goldsieve.operators.numbering import with_row_no
from goldsieve.streaming.sinks import complete


def _appends(spark: SparkSession, store: str) -> list[int]:
    return complete(spark, f"{store}/appends", "append_id")


def numbers(spark: SparkSession, store: str) -> DataFrame:
    """All numbered keys: the key's columns, ``row_no`` and ``append_id``."""
    found = _appends(spark, store)
    if not found:
        raise ValueError(f"{store} has no whole append")
    append_id = F.col("append_id").cast("bigint").alias("append_id")
    rows = spark.read.option("basePath", f"{store}/appends").parquet(
        *(f"{store}/appends/append_id={number}" for number in found)
    )
    return rows.select(*(name for name in rows.columns if name != "append_id"), append_id)


def append_numbers(rows: DataFrame, key: Sequence[str], store: str, append_id: int) -> DataFrame:
    """Number the keys of ``rows`` that the store does not know; all numbers then.

    Known keys keep their number.  New ones go on from the highest number without gaps, in
    the order of the key: only they are sorted.  A key that comes several times has one
    number, null is a key like any other, and an append without new keys adds nothing.
    An append that is whole already is left as it is, so a job can be run again.  Not to
    be run beside another append to the same store.
    """
    if not key or {"row_no", "append_id"} & set(key):
        raise ValueError("key must name columns other than row_no and append_id")
    spark = rows.sparkSession
    whole = _appends(spark, store)
    if append_id in whole:
        return numbers(spark, store)
    fresh, offset = rows.select(*key).distinct(), F.lit(0)
    if whole:
        known = numbers(spark, store)
        old, new = known.alias("old"), fresh.alias("new")
        same = reduce(
            lambda both, one: both & one,
            (F.col(f"new.`{name}`").eqNullSafe(F.col(f"old.`{name}`")) for name in key),
        )
        fresh = new.join(old, same, "left_anti").select(*key)
        offset = known.agg(F.coalesce(F.max("row_no") + 1, F.lit(0))).scalar()
    numbered = with_row_no(written(fresh, "fresh"), list(key))
    folder = f"{store}/appends/append_id={append_id}"
    (
        numbered.select(*key, (F.col("row_no") + offset).cast("bigint").alias("row_no"))
        .write.mode("overwrite")
        .parquet(folder)
    )
    return numbers(spark, store)
