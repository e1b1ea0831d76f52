"""Time the headline operators and print one JSON line.

The derived problems and completions are written once, as an ingested run
would lie on disk, and every operator then reads them from there.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldsieve.durable import new_folder, written
from goldsieve.operators.completions import attach_completions
from goldsieve.operators.holdout import split_holdout
from goldsieve.operators.numbering import with_row_no
from goldsieve.operators.parsing import parse_lenient, parse_strict
from goldsieve.operators.problems import template_kept, template_problems
from goldsieve.operators.prompts import render_messages
from goldsieve.operators.reports import batch_report, run_report
from goldsieve.operators.selection import best_of_n
from goldsieve.operators.voting import vote_phrased, vote_tagged
from goldsieve.plans.curation import judge, kept_records
from goldsieve.plans.evaluation import evaluate
from goldsieve.plans.training_set import training_set
from goldsieve.session import configured
from goldsieve.sources.derived import derived_completions, derived_problems, table
from goldsieve.functions.text import clean_completion
from goldsieve.sources.packs import packs_table
from goldsieve.sources.readers import completion_stream, read_kept
from goldsieve.sources.writers import write_kept
from goldsieve.streaming.curation import curate_stream, streamed_kept

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def _session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("goldsieve-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    spark = configured(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _seconds(build) -> float:
    """Time from building the plan to the last row, result discarded."""
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def _kept_round_trip(spark: SparkSession, kept: DataFrame) -> DataFrame:
    path = new_folder(spark, "kept")
    write_kept(kept, path, "org/teacher", "orders", "boring", "train")
    return read_kept(spark, path, mode="boring")


def _streamed(spark: SparkSession, problems: DataFrame, completions: DataFrame) -> DataFrame:
    arriving, sink = new_folder(spark, "arriving"), new_folder(spark, "sink")
    completions.drop("variant").write.json(arriving)
    prompts = problems.drop("answer", "teacher", "mode")
    stream = completion_stream(spark, arriving)
    curate_stream(stream, prompts, sink, new_folder(spark, "progress")).awaitTermination()
    return streamed_kept(spark, sink)


def main() -> None:
    spark = _session()
    start = time.perf_counter()
    problems = written(derived_problems(spark, FOLDER).withColumn("id", F.col("problem_id")))
    completions = written(derived_completions(spark, FOLDER))
    derive = time.perf_counter() - start

    gold = problems.select("problem_id", "gold")
    packs = packs_table(spark)

    def prompts() -> DataFrame:
        rows = template_problems(problems, carry=["problem_id"]).rows
        return render_messages(rows, packs, "generate", mode="boring")

    def batches() -> DataFrame:
        flags = judge(completions, gold).select("problem_id", "sample_no", "kept")
        numbered = with_row_no(written(flags), ["problem_id", "sample_no"])
        return batch_report(numbered, 18)

    queries = {
        "strict_parse": lambda: parse_strict(completions),
        "lenient_parse": lambda: parse_lenient(completions),
        "curate_kept": lambda: kept_records(judge(completions, problems), "train"),
        "curate_report": lambda: run_report(judge(completions, problems), ["teacher", "mode"]),
        "tagged_vote": lambda: vote_tagged(completions),
        "phrased_vote": lambda: vote_phrased(completions),
        "evaluate": lambda: evaluate(problems, completions).results,
        "best_of_n": lambda: best_of_n(completions, gold),
        "holdout": lambda: split_holdout(problems, "problem_id"),
        "batch_report": batches,
        "generation_prompts": prompts,
        "clean_pages": lambda: table(spark, FOLDER, "pages").select(clean_completion("html")),
    }
    kept = written(kept_records(judge(completions, problems), "train"))
    queries |= {
        "attach": lambda: attach_completions(problems.select("problem_id"), completions, how="left").rows,
        "row_numbers": lambda: with_row_no(gold, ["problem_id"]),
        "training_set": lambda: training_set(
            template_kept(with_row_no(kept, ["id", "assistant_answer"]), carry=["id", "row_no"]),
            packs, "surreal", key="row_no",
        ),
        "kept_sink": lambda: _kept_round_trip(spark, kept),
        "stream": lambda: _streamed(spark, problems, completions),
    }
    times = {
        name: round(min(_seconds(build) for _ in range(RUNS)), 3)
        for name, build in queries.items()
    }
    samples = completions.count()
    scale = re.search(r"sf([0-9.]+)", FOLDER)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                # Building the inputs runs once and counts as well.
                "value": round(sum(times.values()) + derive, 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
                "samples": samples,
                "samples_per_sec": {
                    name: round(samples / times[name])
                    for name in ("strict_parse", "curate_kept", "tagged_vote", "best_of_n")
                },
                "derive_inputs_sec": round(derive, 3),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
