"""Files out and back in, and the streaming job."""

import json

import pytest
from pyspark.sql import functions as F

from goldsieve import schemas
from goldsieve.operators.problems import template_kept
from goldsieve.plans.curation import curate, judge
from goldsieve.plans.training_set import training_set
from goldsieve.sources.derived import derived_completions, derived_problems
from goldsieve.sources.packs import packs_table
from goldsieve.sources.readers import completion_stream, read_kept, read_problems, read_results
from goldsieve.sources.writers import short_name, write_kept, write_results, write_training_set
from goldsieve.streaming.curation import (
    batch_metrics,
    curate_stream,
    running_success,
    streamed_kept,
)


def _kept(spark, *rows):
    filled = [(*row, "s", "q", "1", "r", "1", "e", "t") for row in rows]
    return spark.createDataFrame(filled, schemas.KEPT)


def test_short_name():
    assert short_name("org/model-7b") == "model-7b" and short_name("plain") == "plain"
    assert short_name("org/model/revision") == "model"


def test_kept_lines_hold_the_record_unescaped(spark, tmp_path):
    path = str(tmp_path / "kept")
    row = (7, "train", "é 日", "1", "r", "1", "e", "t")
    write_kept(spark.createDataFrame([row], schemas.KEPT), path, "o/t", "sums", "boring", "train")
    [file] = tmp_path.rglob("part-*.json")
    folders = file.parent.relative_to(path).as_posix()
    assert folders == "teacher=t/dataset=sums/mode=boring/subset=train"
    line = file.read_text(encoding="utf-8").strip()
    assert "é 日" in line
    assert list(json.loads(line)) == schemas.KEPT.fieldNames()


def test_overwrite_touches_one_run_only(spark, tmp_path):
    path = str(tmp_path / "kept")
    write_kept(_kept(spark, (1,)), path, "o/t", "sums", "boring", "train")
    write_kept(_kept(spark, (2,)), path, "o/t", "sums", "surreal", "train")
    write_kept(_kept(spark, (3,)), path, "o/t", "sums", "boring", "train")
    assert {r.id for r in read_kept(spark, path).collect()} == {2, 3}
    chosen = read_kept(spark, path, mode="surreal")
    assert {r.id for r in chosen.collect()} == {2}
    assert "PartitionFilters: [isnotnull(mode" in chosen._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        read_kept(spark, path, colour="red")


def test_broken_lines_are_kept_aside(spark, tmp_path):
    path = str(tmp_path / "kept")
    write_kept(_kept(spark, (1,)), path, "o/t", "sums", "boring", "train")
    [file] = tmp_path.rglob("part-*.json")
    extra = file.with_name("part-extra.json")
    extra.write_text("{not json\n")
    rows = read_kept(spark, path).collect()
    assert {(r.id, r._corrupt_record) for r in rows} == {(1, None), (None, "{not json")}


def test_result_lines_keep_nulls(spark, tmp_path):
    path = str(tmp_path / "results")
    row = (1, "test", "q", "1", None, None, False)
    write_results(
        spark.createDataFrame([row], schemas.RESULT), path, "o/m", "o/t", "sums", "default", "22"
    )
    [file] = tmp_path.rglob("part-*.json")
    assert json.loads(file.read_text()) == dict(zip(schemas.RESULT.fieldNames(), row))
    [back] = read_results(spark, path, model="m", note="22").collect()
    assert tuple(back)[:7] == row and back.with_adapter == "true"


@pytest.mark.parametrize("file_format", ["parquet", "json", "csv"])
def test_problem_sources(spark, tmp_path, file_format):
    path = str(tmp_path / file_format)
    rows = [("q1", 'a "b"\n#### 1', "train"), ("q2", "c\n#### 2", "test")]
    df = spark.createDataFrame(rows, "question string, answer string, split string")
    writer = df.write.partitionBy("split").format(file_format)
    if file_format == "csv":
        writer = writer.options(header=True, escape='"')
    writer.save(path)
    [row] = read_problems(spark, path, "train", file_format).collect()
    assert tuple(row) == rows[0]


def test_training_set_round_trip(spark, folder, tmp_path):
    prompts = derived_problems(spark, folder).withColumn("id", F.col("problem_id"))
    kept = curate(prompts, derived_completions(spark, folder)).kept
    write_kept(kept, str(tmp_path / "kept"), "o/t", "orders", "surreal", "train")
    again = read_kept(spark, str(tmp_path / "kept"), mode="surreal")
    templates = template_kept(again, carry=["id"])
    rows = training_set(templates, packs_table(spark), "surreal")
    write_training_set(rows, str(tmp_path / "set"))
    back = spark.read.parquet(str(tmp_path / "set"))
    assert back.count() == kept.count()
    assert back.where("size(messages) = 3").count() == back.count()
    assert back.where("subset = 'validation'").count() >= back.count() / 10


def test_streamed_equals_batch_and_replays_do_not_double(spark, folder, tmp_path):
    prompts = (
        derived_problems(spark, folder).withColumn("id", F.col("problem_id")).drop("answer")
    )
    completions = derived_completions(spark, folder)
    arriving, sink = str(tmp_path / "in"), str(tmp_path / "out")
    completions.drop("variant").repartition(3).write.json(arriving)

    def run(progress):
        stream = completion_stream(spark, arriving, files_per_batch=1)
        curate_stream(stream, prompts, sink, str(tmp_path / progress)).awaitTermination()

    run("a")
    batch = sorted(map(tuple, curate(prompts, completions).kept.collect()))
    assert sorted(map(tuple, streamed_kept(spark, sink).collect())) == batch
    run("a")
    with pytest.raises(ValueError, match="another checkpoint"):
        run("b")
    assert sorted(map(tuple, streamed_kept(spark, sink).collect())) == batch

    rows = batch_metrics(spark, sink).orderBy("batch_id").collect()
    assert len(rows) == 3
    assert rows[-1].running_kept == len(batch)
    assert rows[-1].running_total == completions.count()


def test_running_success_of_a_stream(spark, folder, tmp_path):
    prompts = derived_problems(spark, folder)
    completions = derived_completions(spark, folder)
    completions.drop("variant").repartition(2).write.json(str(tmp_path / "in"))
    stream = completion_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    counts = running_success(judge(stream, prompts), ["mode"])
    query = (
        counts.writeStream.outputMode("complete")
        .format("memory")
        .queryName("running")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    found = {r["mode"]: (r.kept, r.total) for r in spark.table("running").collect()}
    wanted = judge(completions, prompts).groupBy("mode").agg(
        F.count_if("kept").alias("kept"), F.count("*").alias("total")
    )
    assert found == {r["mode"]: (r.kept, r.total) for r in wanted.collect()}


def test_a_stream_without_rows_is_an_empty_table(spark, folder, tmp_path):
    prompts = derived_problems(spark, folder).withColumn("id", F.col("problem_id"))
    (tmp_path / "in").mkdir()
    stream = completion_stream(spark, str(tmp_path / "in"))
    sink = str(tmp_path / "out")
    curate_stream(stream, prompts, sink, str(tmp_path / "progress")).awaitTermination()
    assert streamed_kept(spark, sink).count() == 0 and batch_metrics(spark, sink).count() == 0


def test_an_empty_note_reads_back(spark, tmp_path):
    row = (1, "test", "q", "1", None, None, False)
    results = spark.createDataFrame([row], schemas.RESULT)
    write_results(results, str(tmp_path), "o/m", "o/t", "sums", "default", note="")
    assert read_results(spark, str(tmp_path), note="").count() == 1
