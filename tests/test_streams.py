"""Streams: state, restarts, folds, late problems, and cut-off writes."""

import random

import pytest
from pyspark.sql import functions as F

from goldsieve import schemas
from goldsieve.operators.selection import best_of_n
from goldsieve.operators.voting import vote_tagged
from goldsieve.plans.curation import judge
from goldsieve.sources.readers import completion_stream
from goldsieve.streaming.curation import curate_stream, latest_success, running_success_stream
from goldsieve.streaming.late import all_kept, all_verdicts, parked, regrade
from goldsieve.streaming.selection import (
    best_stream,
    fold_best,
    fold_votes,
    streamed_best,
    streamed_votes,
    vote_stream,
)
from goldsieve.streaming.sinks import complete, sink_rows

PROMPTS = "problem_id long, id long, question string, gold string"


def _completion(reason, answer, closing):
    return (
        f"<trip_before>{'r' * reason}</trip_before><answer>{answer}</answer>"
        f"<end>{'e' * closing}</end>"
    )


def _samples(seed, problems=12, n=9):
    """Rows in a mixed order: right, wrong, unparsed and null texts, and unknown problems."""
    pick, rows = random.Random(seed), []
    for problem in [*range(problems), 99, None]:
        for sample in range(pick.randint(1, n)):
            text = pick.choice(
                [_completion(pick.randint(28, 60), pick.randint(4, 7), pick.randint(28, 60)), "no tags, 5", None, "x", "<answer></answer>"]
            )
            rows.append((problem, sample, text))
    pick.shuffle(rows)
    return rows


def _arrive(spark, rows, path):
    spark.createDataFrame(rows, schemas.COMPLETION).coalesce(1).write.mode("append").json(path)


def _problems(spark, n=12):
    rows = [(k, 100 + k, f"q{k}", None if k == 3 else str(4 + k % 4)) for k in range(n)]
    return spark.createDataFrame(rows, PROMPTS)


def _set(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture
def paths(tmp_path):
    return [str(tmp_path / name) for name in ("arriving", "sink", "progress", "late")]


@pytest.mark.parametrize("cuts", [(5, 20, 33), (40,)])
def test_votes_and_best_after_each_batch(spark, paths, tmp_path, cuts):
    """After every batch the outcome is that of all rows so far, whatever was folded."""
    arriving, sink, progress, _ = paths
    best, best_progress = str(tmp_path / "best"), str(tmp_path / "best_progress")
    rows, problems = _samples(1), _problems(spark)
    edges = [0, *cuts, len(rows)]
    for turn, (low, high) in enumerate(zip(edges, edges[1:])):
        _arrive(spark, rows[low:high], arriving)
        vote_stream(completion_stream(spark, arriving), sink, progress).awaitTermination()
        best_stream(completion_stream(spark, arriving), best, best_progress).awaitTermination()
        so_far = spark.createDataFrame(rows[:high], schemas.COMPLETION)
        for _ in range(2):
            assert _set(streamed_votes(spark, sink)) == _set(vote_tagged(so_far))
            assert _set(streamed_best(spark, best, problems)) == _set(best_of_n(so_far, problems))
            if turn % 2:
                continue
            assert fold_votes(spark, sink) == fold_best(spark, best) == turn


def test_votes_are_compared_without_texts(spark, paths):
    arriving, sink, progress, _ = paths
    _arrive(spark, _samples(2), arriving)
    vote_stream(completion_stream(spark, arriving), sink, progress).awaitTermination()
    plan = streamed_votes(spark, sink)._jdf.queryExecution().executedPlan().toString()
    assert "json" not in plan.lower() and "regexp" not in plan
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert any("text" not in line.split("ReadSchema")[1] for line in scans)


def test_a_cut_off_fold_changes_nothing(spark, paths):
    arriving, sink, progress, _ = paths
    rows = _samples(3)
    _arrive(spark, rows, arriving)
    vote_stream(completion_stream(spark, arriving), sink, progress).awaitTermination()
    wanted = _set(streamed_votes(spark, sink))
    # A fold that stopped before its mark: its rows are not read, and are replaced.
    half = sink_rows(spark, sink).drop("batch_id").limit(1)
    half.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{sink}/folded/upto=0")
    assert complete(spark, f"{sink}/folded", "upto") == []
    assert _set(streamed_votes(spark, sink)) == wanted
    assert fold_votes(spark, sink) == 0 and complete(spark, f"{sink}/folded", "upto") == [0]
    assert _set(streamed_votes(spark, sink)) == wanted


def test_running_success_survives_a_restart(spark, paths):
    arriving, sink, progress, _ = paths
    rows, problems = _samples(4), _problems(spark)
    for low, high in ((0, 10), (10, 25), (25, len(rows))):
        _arrive(spark, rows[low:high], arriving)
        graded = judge(completion_stream(spark, arriving), problems)
        running_success_stream(graded, ["question"], sink, progress).awaitTermination()
        judged = judge(spark.createDataFrame(rows[:high], schemas.COMPLETION), problems)
        counts = judged.groupBy("question").agg(F.count_if("kept").alias("kept"), F.count("*").alias("total"))
        assert _set(latest_success(spark, sink, ["question"]).drop("success_pct")) == _set(counts)
    # A batch writes only the keys that it changed.
    assert sink_rows(spark, sink).where("batch_id = 1").count() < counts.count()
    with pytest.raises(ValueError, match="another checkpoint"):
        running_success_stream(graded, ["question"], sink, f"{progress}2")


def test_late_problems_any_order(spark, paths):
    arriving, sink, progress, late = paths
    rows, problems = _samples(5), _problems(spark)
    judged = judge(spark.createDataFrame(rows, schemas.COMPLETION), problems)
    wanted = judged.select("problem_id", "sample_no", "text", F.coalesce("reject_reason", F.lit("kept")))
    known = [problems.where("problem_id < 4"), problems.where("problem_id < 9"), problems]
    for turn, (low, high) in enumerate(((0, 15), (15, 30), (30, len(rows)))):
        _arrive(spark, rows[low:high], arriving)
        stream = completion_stream(spark, arriving)
        curate_stream(stream, known[max(0, turn - 1)], sink, progress).awaitTermination()
        # The second pass finds nothing that the first left.
        assert regrade(spark, sink, late, known[turn]) == 2 * turn + 1
        assert regrade(spark, sink, late, known[turn]) == 2 * turn + 2
        assert all_verdicts(spark, sink, late).count() == high
    assert _set(all_verdicts(spark, sink, late).drop("batch_id")) == _set(wanted)
    assert {row.problem_id for row in parked(spark, sink, late).collect()} == {99, None}
    assert all_kept(spark, sink, late).count() == judged.where("kept").count()


def test_a_cut_off_pass_is_replaced(spark, paths):
    arriving, sink, progress, late = paths
    rows, problems = _samples(6), _problems(spark)
    _arrive(spark, rows, arriving)
    curate_stream(completion_stream(spark, arriving), problems.limit(0), sink, progress).awaitTermination()
    assert parked(spark, sink, late).count() == all_verdicts(spark, sink, late).count() == len(rows)
    unmarked = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    some = spark.read.parquet(sink).limit(3).withColumn("verdict", F.lit("kept"))
    some.write.option(unmarked, "false").partitionBy("verdict").parquet(f"{late}/pass=1")
    assert parked(spark, sink, late).count() == len(rows)
    assert regrade(spark, sink, late, problems) == 1
    verdicts = all_verdicts(spark, sink, late)
    assert verdicts.count() == len(rows)
    assert verdicts.where("verdict = 'no_problem'").count() == sum(row[0] in (99, None) for row in rows)
