"""Plan shapes and skew: what has to hold for the operators to scale."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

from goldsieve.durable import release, shared_folder, written
from goldsieve.operators.holdout import split_holdout
from goldsieve.operators.numbering import with_row_no
from goldsieve.operators.reports import batch_report
from goldsieve.operators.selection import best_of_n
from goldsieve.operators.voting import vote_phrased, vote_tagged
from goldsieve.plans.catalog import ARRIVING, _arrive, kept_round_trip
from goldsieve.plans.curation import judge, kept_records
from goldsieve.plans.evaluation import evaluate
from goldsieve.sources.derived import _long_orders, derived_completions, derived_problems

HOT = 3_000


@pytest.fixture(scope="module")
def inputs(spark, folder):
    problems = derived_problems(spark, folder).withColumn("id", F.col("problem_id"))
    return written(problems), written(derived_completions(spark, folder))


@pytest.fixture(scope="module")
def skewed(spark, inputs):
    """As many samples again, all of one problem."""
    problems, completions = inputs
    hot = spark.range(1, HOT + 1).select(
        F.lit(1).cast("long").alias("problem_id"),
        (F.col("id") + 1000).cast("int").alias("sample_no"),
        F.lit(0).alias("variant"),
        F.concat(F.lit("<answer>"), F.col("id") % 50, F.lit("</answer>")).alias("text"),
    )
    return problems, written(completions.unionByName(hot))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return _plan(df)


def _nodes(plan, name):
    return [line for line in plan.splitlines() if re.search(rf"(^|[-: +*()0-9]){name}\b", line)]


def test_single_partition_windows_see_summaries_only(inputs, spark):
    """Such a window may only sit on an aggregate, never on data rows."""
    problems, completions = inputs
    numbered = with_row_no(problems.select("problem_id"), ["problem_id"])
    report = batch_report(numbered.withColumn("kept", F.lit(True)), 18)
    for df in (numbered, report, split_holdout(problems, "problem_id")):
        lines = df._jdf.queryExecution().toString().splitlines()
        for at, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert "HashAggregate" in "".join(lines[at + 1 : at + 3])


def test_scans_read_only_what_they_need(inputs):
    problems, completions = inputs
    counts = judge(completions, problems).groupBy("kept").count()
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", _plan(counts))
    assert sorted(schemas) == ["problem_id:bigint,gold:string", "problem_id:bigint,text:string"]


def test_reports_do_not_shuffle_texts(inputs):
    problems, completions = inputs
    counts = judge(completions, problems).groupBy("kept").count()
    lines = _plan(counts).splitlines()
    joined = next(n for n, line in enumerate(lines) if re.search("(HashJoin|MergeJoin)", line))
    below = next(line for line in lines[joined + 1 :] if "Project [" in line)
    assert "AS _flaw" in below and "AS parsed" not in below


def test_curation_shuffles_once_per_side(inputs, spark):
    problems, completions = inputs
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(kept_records(judge(completions, problems), "train"))
        assert len(_nodes(plan, "Exchange")) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_intermediate_folders_go(spark, monkeypatch):
    monkeypatch.setattr("goldsieve.durable._folders", [])
    table = written(spark.range(5))
    [file] = table.inputFiles()[:1]
    release()
    assert not pathlib.Path(file.removeprefix("file://")).exists()


def test_holdout_does_not_move_rows(inputs):
    problems, _ = inputs
    main = _plan(split_holdout(problems, "problem_id")).split("Subquer")[0]
    assert "Exchange" not in main and "Join" not in main


def test_votes_are_combined_before_each_shuffle(inputs):
    _, completions = inputs
    plan = _plan(vote_phrased(completions))
    assert len(_nodes(plan, "Exchange")) == 2
    assert "partial_count" in plan and "partial_min_by" in plan
    # Three patterns, each run once: no filter repeats the extraction.
    assert plan.count("regexp_extract_all") == 3


def test_no_text_moves_below_the_winner(inputs, spark):
    problems, completions = inputs
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, rank in ((best_of_n(completions, problems), "_rank"), (vote_tagged(completions), "_votes")):
            lines = _plan(df).splitlines()
            assert any("partial_max(_rank" in line or "partial_count" in line for line in lines)
            # The fetch of the winners' texts is the only move of a text.
            ranked = [line for line in lines if rank in line and "Aggregate" in line]
            assert ranked and not any("text" in line or "parsed" in line for line in ranked)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_winners_are_read_once(inputs, spark):
    """The extraction of a winner's text is not repeated in the join's condition."""
    problems, completions = inputs
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        best = best_of_n(completions, problems)._jdf.queryExecution().optimizedPlan().toString()
        assert best.count("regexp_extract") < 250
        for df in (best_of_n(completions, problems), vote_tagged(completions)):
            joins = [line for line in _plan(df).splitlines() if re.search("(HashJoin|MergeJoin)", line)]
            assert joins and not any("regexp" in line for line in joins)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbers_are_read_before_the_join(inputs):
    problems, completions = inputs
    lines = _plan(judge(completions, problems)).splitlines()
    joined = next(n for n, line in enumerate(lines) if re.search("(HashJoin|MergeJoin)", line))
    assert not any("try_cast" in line for line in lines[: joined + 1])
    assert any("try_cast" in line for line in lines[joined + 1 :])


def test_heavy_problem_is_split_in_the_join(spark, skewed):
    problems, completions = skewed
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        assert "skew=true" in _final_plan(judge(completions.repartition(8), problems))
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_heavy_problem_votes_right(skewed):
    problems, completions = skewed
    hot = vote_tagged(completions.where("problem_id = 1 and sample_no > 1000")).collect()
    assert [(r.answer, r.text) for r in hot] == [("1", "<answer>1</answer>")]
    results = evaluate(problems, completions).results
    assert results.count() == problems.count()


def test_heavy_order_is_numbered_right(spark, folder, tmp_path):
    """One order with half of all line items, many of them exact copies."""
    source = spark.read.parquet(f"{folder}/lineitem.parquet")
    heavy = source.withColumn("l_orderkey", F.lit(1).cast("long"))
    one = source.orderBy("l_orderkey", "l_partkey").limit(1)
    copies = one.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n")
    source.unionByName(heavy).unionByName(copies).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.read.parquet(f"{folder}/orders.parquet").write.parquet(str(tmp_path / "orders.parquet"))
    samples = derived_completions(spark, str(tmp_path))
    per_order = samples.groupBy("problem_id").agg(
        F.count("*").alias("n"),
        F.countDistinct("sample_no").alias("distinct"),
        F.min("sample_no").alias("low"),
        F.max("sample_no").alias("high"),
    )
    wrong = per_order.where("n <> distinct or low <> 1 or high <> n")
    assert wrong.count() == 0
    assert per_order.agg(F.max("n")).first()[0] > 6000


def test_lines_are_numbered_without_a_copy(spark, folder, monkeypatch):
    """No order is long, so no sorted copy of all lines is written."""
    monkeypatch.setattr("goldsieve.durable._folders", made := [])
    derived_completions(spark, folder)
    assert made == []


def test_long_orders_are_numbered_like_others(spark, folder, monkeypatch):
    short = derived_completions(spark, folder)
    monkeypatch.setattr("goldsieve.sources.derived.LONG_ORDER", 4)
    mixed = derived_completions(spark, folder)
    assert mixed.exceptAll(short).isEmpty() and short.exceptAll(mixed).isEmpty()


def test_known_rows_bound_a_sorting_task(spark, monkeypatch):
    monkeypatch.setattr("goldsieve.operators.numbering.SORTED_ROWS", 50)
    monkeypatch.setattr("goldsieve.durable._folders", made := [])
    rows = spark.range(2_000).select((F.lit(2_000) - F.col("id")).alias("k"))
    assert with_row_no(rows, ["k"], rows=2_000).where("row_no <> k - 1").isEmpty()
    [folder] = made
    assert len(list(pathlib.Path(folder.removeprefix("file:")).glob("part-*"))) >= 30


def test_number_of_arriving_files_is_fixed(spark, tmp_path):
    """Each micro-batch meets all problems, so batches must not grow in number."""
    rows = spark.range(4_000).repartition(40).selectExpr("id AS problem_id", "1 AS sample_no", "'t' AS text")
    _arrive(rows, str(tmp_path / "in"))
    assert len(list((tmp_path / "in").glob("part-*"))) <= ARRIVING
    assert spark.read.parquet(str(tmp_path / "in")).count() == 4_000


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or spark.sparkContext.getCheckpointDir())


def test_kept_lines_are_packed_and_numbering_takes_no_more_than_it_needs(spark, folder, monkeypatch):
    monkeypatch.setattr("goldsieve.durable._folders", made := [])
    back = kept_round_trip(spark, folder)
    assert back.count() > 0 and all(name.endswith(".json.gz") for name in back.inputFiles())
    [numbered] = [name for name in made if "-numbered-" in name]
    assert sorted(spark.read.parquet(numbered).columns) == ["_place", "gold", "problem_id", "question"]


def test_long_orders_are_found_by_groups_of_keys(spark, monkeypatch):
    """Keys are counted only if a group of them has so many lines."""
    monkeypatch.setattr("goldsieve.sources.derived.LONG_ORDER", 30)
    monkeypatch.setattr("goldsieve.sources.derived.KEY_GROUPS", 4)
    keys = spark.range(40).selectExpr("id % 13 AS l_orderkey")
    heavy = spark.range(62).selectExpr("100 + id % 2 AS l_orderkey")
    assert _long_orders(spark.range(13).selectExpr("id AS l_orderkey")) == []
    assert _long_orders(keys.unionByName(keys)) == []
    assert sorted(_long_orders(keys.unionByName(heavy))) == [100, 101]
