"""Numbering, hold-out, batches and reports."""

import math

import pytest
from pyspark.sql import functions as F

from goldsieve.operators import numbering
from goldsieve.operators.holdout import split_holdout
from goldsieve.operators.numbering import running_total, with_row_no
from goldsieve.operators.reports import as_printed, batch_report, run_report


def test_row_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"))
    rows = with_row_no(df, ["k"]).collect()
    assert sorted((r.k, r.row_no) for r in rows) == [(n, n) for n in range(1000)]


def test_row_numbers_with_one_heavy_key(spark, tmp_path):
    rows = spark.range(9000).select(F.when(F.col("id") < 6000, 5).otherwise(F.col("id")).alias("k"))
    rows.write.parquet(str(tmp_path / "k"))
    df = spark.read.parquet(str(tmp_path / "k"))
    numbered = with_row_no(df, ["k"], spread_ties=True).orderBy("row_no").collect()
    assert [r.row_no for r in numbered] == list(range(9000))
    assert [r.k for r in numbered] == sorted(r.k for r in df.collect())


def test_running_total_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(numbering, "_CHUNK", 7)
    df = spark.range(1, 101).select(F.col("id").alias("n"), (F.col("id") % 3).alias("v"))
    rows = running_total(df, "n", {"upto": "v"}).orderBy("n").collect()
    assert [r.upto for r in rows] == [sum(k % 3 for k in range(1, n + 1)) for n in range(1, 101)]


@pytest.mark.parametrize("n, held", [(7473, 748), (10, 1), (11, 2), (1, 1), (0, 0)])
def test_holdout_is_exact(spark, n, held):
    df = split_holdout(spark.range(n), "id")
    assert df.where("is_validation").count() == held
    assert df.where(~F.col("is_validation")).count() == n - held


def test_holdout_does_not_depend_on_partitions(spark):
    def members(parts, seed=42):
        df = spark.range(2000).repartition(parts)
        return {r.id for r in split_holdout(df, "id", seed=seed).where("is_validation").collect()}

    assert members(1) == members(7)
    assert members(3) != members(3, seed=43)


def test_holdout_takes_the_smallest_hashes(spark):
    import hashlib

    ids = sorted(range(500), key=lambda n: hashlib.md5(f"{n}:9".encode()).hexdigest())
    df = split_holdout(spark.range(500), "id", fraction=0.25, seed=9)
    held = {r.id for r in df.where("is_validation").collect()}
    assert held == set(ids[: math.ceil(0.25 * 500)])


def test_holdout_keeps_copies_together(spark):
    df = spark.range(900).select(F.when(F.col("id") < 300, 1).otherwise(F.col("id")).alias("k"))
    sides = split_holdout(df, "k").groupBy("k").agg(F.countDistinct("is_validation").alias("n"))
    assert sides.where("n > 1").count() == 0


def _items(spark, total, kept):
    return spark.range(total).select(
        F.col("id").alias("row_no"), (F.col("id") < kept).alias("kept")
    )


@pytest.mark.parametrize("total, batches, last", [(7473, 416, 3), (1319, 74, 5)])
def test_batches(spark, total, batches, last):
    rows = batch_report(_items(spark, total, 500), 18).orderBy("batch_no").collect()
    assert len(rows) == batches
    assert rows[-1].total == last
    assert (rows[-1].running_kept, rows[-1].running_total) == (500, total)
    assert rows[27].success_pct == 77.8 and rows[27].kept == 14


def test_overall_rates(spark):
    [curated] = run_report(_items(spark, 7473, 4840)).collect()
    assert (curated.success_pct, curated.total) == (64.8, 7473)
    [tested] = run_report(_items(spark, 1319, 548)).collect()
    assert tested.rate == 0.415


def test_empty_run_has_no_rate(spark):
    [empty] = run_report(_items(spark, 0, 0)).collect()
    assert (empty.kept, empty.total, empty.success_pct) == (0, 0, None)


def test_subtotals(spark):
    df = spark.createDataFrame(
        [("t1", "a", True), ("t1", "b", False), ("t2", "a", None)],
        "teacher string, mode string, kept boolean",
    )
    report = run_report(df, ["teacher", "mode"]).collect()
    rows = {(r.teacher, r.mode, r.level): (r.kept, r.total) for r in report}
    assert rows[(None, None, 2)] == (1, 3)
    assert rows[("t1", None, 1)] == (1, 2)
    assert rows[("t2", "a", 0)] == (0, 1)
    assert len(rows) == 6


def test_rounding_is_that_of_printed_floats(spark):
    pairs = spark.range(1, 2001).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), "id")).alias("k"))
    shown = pairs.select(
        "k", "n", as_printed(100.0 * F.col("k") / F.col("n"), 1).alias("p"), as_printed(F.col("k") / F.col("n"), 3).alias("r")
    )
    wrong = [row for row in shown.toPandas().itertuples() if row.p != float(f"{100.0 * row.k / row.n:.1f}") or row.r != float(f"{row.k / row.n:.3f}")]
    assert not wrong
