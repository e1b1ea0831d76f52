"""Global row numbers and running totals that never gather the data in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldsieve.durable import written

# monotonically_increasing_id() is (partition number << 33) + row within it.
_ROW_BITS = 33

# Rows per window partition of running_total(); a table of a thousand million
# batches then has a top level of 15,259 chunks.
_CHUNK = 1 << 16

# Rows that one task sorts where the number of rows is known.
SORTED_ROWS = 200_000


def with_row_no(
    df: DataFrame,
    order_by: Sequence[str],
    name: str = "row_no",
    keep: Sequence[str] | None = None,
    spread_ties: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Number the rows 0, 1, .. in the order of ``order_by``.

    The rows are range partitioned and sorted once and written down with their
    place in the partition; the only further work is one count per partition.
    ``df`` runs twice, as its range boundaries come from a sample: hand over a
    ``written`` table if it is costly.
    ``order_by`` should be unique: rows that tie are numbered in any order, and
    land in one task.  ``spread_ties`` splits them over tasks by input
    position; use it only on rows that come straight from files, whose position
    stays the same when a task is run again.
    ``rows`` is the number of rows, if known: a task then sorts about ``SORTED_ROWS``
    of them.  Otherwise Spark goes by shuffled bytes, and wide texts that
    compress well make few, large tasks.
    """
    keep = list(keep or df.columns)
    keys = list(order_by)
    if spread_ties:
        df = df.withColumn("_tie", F.monotonically_increasing_id())
        keys.append("_tie")
    if rows is None:
        ordered = df.orderBy(*keys)
    else:
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SORTED_ROWS))
        ordered = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    place = written(
        ordered
        .withColumn("_place", F.monotonically_increasing_id())
        .select(*keep, "_place"),
        "numbered",
    ).withColumn("_part", F.shiftright("_place", _ROW_BITS))
    # One row per sort partition, so both this window and the broadcast are
    # bounded by the number of shuffle partitions.
    before = (
        place.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select(
            "_part",
            (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"),
        )
    )
    within = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return place.join(F.broadcast(before), "_part").select(
        *keep, (F.col("_before") + within).alias(name)
    )


def running_total(df: DataFrame, order: str, totals: dict[str, Column | str]) -> DataFrame:
    """Add running sums over rows keyed by a dense integer ``order``.

    Sums run inside chunks of consecutive keys; one row per chunk carries what
    came before it.  Both passes read ``df`` from a written copy.
    """
    chunked = written(df, "totals").withColumn("_chunk", F.floor(F.col(order) / F.lit(_CHUNK)))
    sums = {name: F.sum(value) for name, value in totals.items()}
    by_chunk = Window.orderBy("_chunk")
    before = (
        chunked.groupBy("_chunk")
        .agg(*(total.alias(f"_{name}") for name, total in sums.items()))
        .select(
            "_chunk",
            *(
                (F.sum(f"_{name}").over(by_chunk) - F.col(f"_{name}")).alias(f"_before_{name}")
                for name in sums
            ),
        )
    )
    inside = Window.partitionBy("_chunk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # No broadcast hint: this side grows, if slowly, so its size decides.
    return chunked.join(before, "_chunk").select(
        *df.columns,
        *(
            (F.col(f"_before_{name}") + total.over(inside)).alias(name)
            for name, total in sums.items()
        ),
    )
