"""The registered queries: every operator run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldsieve import schemas
from goldsieve.durable import new_folder, written
from goldsieve.functions.text import clean_completion, normalize_text
from goldsieve.operators.completions import attach_completions, fan_out
from goldsieve.operators.extraction import extract_phrased, extract_tagged
from goldsieve.operators.grading import grade, within_length
from goldsieve.operators.holdout import split_holdout
from goldsieve.operators.numbering import with_row_no
from goldsieve.operators.parsing import clean_completions, parse_lenient, parse_strict
from goldsieve.operators.problems import ingest_problems, template_kept, template_problems
from goldsieve.operators.prompts import render_messages
from goldsieve.operators.reports import batch_report, percent
from goldsieve.operators.reports import curation_report as curation_report_of
from goldsieve.operators.selection import best_of_n
from goldsieve.operators.stable_numbers import append_numbers
from goldsieve.operators.voting import vote_phrased, vote_tagged
from goldsieve.plans.curation import curate, judge, rejected
from goldsieve.plans.evaluation import evaluate
from goldsieve.plans.training_set import training_set
from goldsieve.sources.derived import derived_completions, derived_problems, table
from goldsieve.sources.packs import packs_table
from goldsieve.sources.published import publish_kept, read_published_kept
from goldsieve.sources.readers import completion_stream, read_kept, read_problems, read_results
from goldsieve.sources.writers import write_kept, write_results, write_training_set
from goldsieve.streaming.curation import (
    batch_metrics,
    curate_stream,
    latest_success,
    running_success_stream,
    streamed_kept,
)
from goldsieve.streaming.late import all_verdicts, regrade
from goldsieve.streaming.selection import (
    best_stream,
    fold_best,
    fold_votes,
    streamed_best,
    streamed_votes,
    vote_stream,
)

Query = Callable[[SparkSession, str], DataFrame]

_TEACHER = "example/teacher-7b"
# Samples asked for per problem where prompts are fanned out.
SAMPLES = 3
BATCH = 18
# Files that arrive at a stream in one run.  Each micro-batch meets the whole problem
# table, so files grow with the data, not their number; row groups let tasks share them.
ARRIVING = 8
ROW_GROUP = 16 << 20


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Problems with a dense 1-based id."""
    return _with_id(derived_problems(spark, folder))


def _with_id(problems: DataFrame) -> DataFrame:
    numbered = with_row_no(problems, ["problem_id"])
    return numbered.withColumn("id", F.col("row_no") + 1).drop("row_no")


def _samples_with_gold(spark: SparkSession, folder: str) -> DataFrame:
    gold = derived_problems(spark, folder).select("problem_id", "gold")
    return derived_completions(spark, folder).join(gold, "problem_id")


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return judge(derived_completions(spark, folder), derived_problems(spark, folder))


def _fields(df: DataFrame) -> DataFrame:
    return df.select(
        "problem_id",
        "sample_no",
        *(F.col(f"parsed.{name}").alias(name) for name in ("reason", "answer", "closing")),
    )


def curate_kept_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed and kept completions per variant of the format."""
    return (
        _judged(spark, folder)
        .groupBy("variant")
        .agg(
            F.count("*").alias("samples"),
            F.count("parsed").alias("parsed"),
            F.count_if("kept").alias("kept"),
        )
        .withColumn("kept_pct", percent(F.col("kept"), F.col("samples")))
    )


def curate_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    verdict = F.coalesce("reject_reason", F.lit("kept")).alias("verdict")
    return _judged(spark, folder).groupBy(verdict).agg(F.count("*").alias("n"))


def curate_kept_records(spark: SparkSession, folder: str) -> DataFrame:
    # Numbering writes what it is given, so it gets what a record is made of.
    asked = derived_problems(spark, folder).select("problem_id", "question", "gold")
    return curate(_with_id(asked), derived_completions(spark, folder)).kept


def curate_rejects(spark: SparkSession, folder: str) -> DataFrame:
    rejects = rejected(_judged(spark, folder))
    return rejects.select("problem_id", "sample_no", "reject_reason", "text")


def curate_from_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Raw problems to templates to kept counts per run; rejects drop out."""
    problems = derived_problems(spark, folder)
    rows = template_problems(problems, carry=["problem_id", "teacher", "mode"]).rows
    prompts = rows.withColumnRenamed("golden_answer", "gold")
    judged = judge(derived_completions(spark, folder), prompts)
    return judged.where("teacher IS NOT NULL").groupBy("teacher", "mode").agg(
        F.count_if("kept").alias("kept"), F.count("*").alias("total")
    )


def adapter_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ingest_problems(derived_problems(spark, folder), "orders", "train", ["problem_id"])


def template_rows(spark: SparkSession, folder: str) -> DataFrame:
    return template_problems(derived_problems(spark, folder), carry=["problem_id"]).rows


def template_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return template_problems(derived_problems(spark, folder), carry=["problem_id"]).rejects


def template_kept_rows(spark: SparkSession, folder: str) -> DataFrame:
    return template_kept(curate_kept_records(spark, folder), carry=["id"])


def strict_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _fields(parse_strict(derived_completions(spark, folder)))


def lenient_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _fields(parse_lenient(derived_completions(spark, folder)))


def cleaned_completions(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean_completions(derived_completions(spark, folder))
    return cleaned.select("problem_id", "sample_no", "cleaned")


def tagged_answers(spark: SparkSession, folder: str) -> DataFrame:
    answers = extract_tagged(derived_completions(spark, folder))
    return answers.select("problem_id", "sample_no", "answer")


def phrased_answers(spark: SparkSession, folder: str) -> DataFrame:
    answers = extract_phrased(derived_completions(spark, folder))
    return answers.select("problem_id", "sample_no", "answer")


def graded_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Tagged answers against gold, per variant."""
    graded = grade(extract_tagged(_samples_with_gold(spark, folder)))
    return graded.groupBy("variant").agg(
        F.count("*").alias("n"), F.count_if("is_correct").alias("correct")
    )


def tagged_vote(spark: SparkSession, folder: str) -> DataFrame:
    return vote_tagged(derived_completions(spark, folder))


def phrased_vote(spark: SparkSession, folder: str) -> DataFrame:
    return vote_phrased(derived_completions(spark, folder))


def best_samples(spark: SparkSession, folder: str) -> DataFrame:
    return best_of_n(derived_completions(spark, folder), derived_problems(spark, folder))


def evaluation_results(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate(_prompts(spark, folder), derived_completions(spark, folder)).results


def evaluation_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate(_prompts(spark, folder), derived_completions(spark, folder)).accuracy


def evaluation_batches(spark: SparkSession, folder: str) -> DataFrame:
    results = evaluation_results(spark, folder)
    return batch_report(
        results.withColumn("row_no", F.col("id") - 1), BATCH, flag="exact_match"
    )


def curation_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Success per batch of consecutive completions, with running totals."""
    judged = _judged(spark, folder).select("problem_id", "sample_no", "kept")
    numbered = with_row_no(written(judged, "judged"), ["problem_id", "sample_no"])
    return batch_report(numbered, BATCH)


def curation_report(spark: SparkSession, folder: str) -> DataFrame:
    problems = derived_problems(spark, folder)
    judged = judge(derived_completions(spark, folder), problems)
    return curation_report_of(judged, problems, by=["teacher", "mode"])


def numbered_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return with_row_no(orders, ["o_totalprice", "o_orderkey"], keep=["o_orderkey"])


def holdout_members(spark: SparkSession, folder: str) -> DataFrame:
    problems = derived_problems(spark, folder).select("problem_id")
    return split_holdout(problems, "problem_id")


def generation_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts with the gold shown, the pack chosen by a column."""
    problems = derived_problems(spark, folder)
    rows = template_problems(problems, carry=["problem_id", "mode"]).rows
    style = F.when(F.col("mode") == "F", "surreal").otherwise("boring")
    rendered = render_messages(
        rows.withColumn("style", style),
        packs_table(spark),
        "generate",
        mode_column="style",
    )
    return rendered.select("problem_id", "style", "prompt")


def evaluation_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """One prompt per problem and sample; keys fan out, texts join afterwards."""
    problems = derived_problems(spark, folder).select("problem_id", "question")
    rendered = render_messages(problems, packs_table(spark), "eval", mode="default")
    asked = fan_out(problems.select("problem_id"), SAMPLES)
    return asked.join(rendered.select("problem_id", "prompt"), "problem_id")


def conversation_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Training messages of every user turn that an assistant turn follows."""
    turns = table(spark, folder, "conversations")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    replies = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_target")
    )
    pairs = asked.join(replies, ["conv_id", "turn"])
    rendered = render_messages(pairs, packs_table(spark), "train", mode="default")
    return rendered.select(
        "conv_id", "turn", F.posexplode("messages").alias("position", "message")
    ).select("conv_id", "turn", "position", "message.role", "message.content")


def fanned_out(spark: SparkSession, folder: str) -> DataFrame:
    return fan_out(derived_problems(spark, folder).select("problem_id"), SAMPLES)


def _attached(spark: SparkSession, folder: str):
    return attach_completions(
        fanned_out(spark, folder),
        derived_completions(spark, folder),
        on=["problem_id", "sample_no"],
        how="left",
    )


def attached_completions(spark: SparkSession, folder: str) -> DataFrame:
    return _attached(spark, folder).rows.select("problem_id", "sample_no", "text")


def outstanding_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return _attached(spark, folder).outstanding


def orphan_completions(spark: SparkSession, folder: str) -> DataFrame:
    return _attached(spark, folder).orphans.select("problem_id", "sample_no", "text")


def repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that would multiply rows if line items were taken for prompts."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("problem_id"), F.col("l_linenumber").alias("sample_no")
    )
    samples = derived_completions(spark, folder)
    return attach_completions(lines, samples, on=["problem_id", "sample_no"]).repeated


def _training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Kept completions as targets, split by a number that each row has alone."""
    kept = written(curate_kept_records(spark, folder), "kept")
    numbered = with_row_no(kept, ["id", "assistant_answer"], rows=kept.count())
    templates = template_kept(numbered, carry=["id", "row_no"])
    return training_set(templates, packs_table(spark), "surreal", key="row_no")


def training_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Kept completions as targets."""
    return _training_rows(spark, folder).select("id", "row_no", "is_validation", "prompt")


def training_set_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The training set through its sink, read back by subset."""
    path = new_folder(spark, "training")
    write_training_set(_training_rows(spark, folder), path)
    back = spark.read.parquet(path)
    return back.select("id", "row_no", "subset", "assistant_target")


def problems_by_split(spark: SparkSession, folder: str) -> DataFrame:
    """Raw problems written by split, and each split read back by name and templated."""
    path = new_folder(spark, "problems")
    problems = derived_problems(spark, folder).select("question", "answer", F.col("mode").alias("split"))
    problems.write.partitionBy("split").parquet(path)
    found = None
    for row in problems.select("split").distinct().orderBy("split").collect():
        rows = template_problems(read_problems(spark, path, row["split"]), carry=["split"]).rows
        part = rows.select("split", "question", "golden_answer", "assistant_target")
        found = part if found is None else found.unionByName(part)
    return found


def plain_training_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The problems' own solutions as targets."""
    templates = template_problems(derived_problems(spark, folder), carry=["problem_id"]).rows
    rows = training_set(templates, packs_table(spark), "default", key="problem_id")
    return rows.select("problem_id", "is_validation", "prompt")


def document_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Both answer extractors on whole documents."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    both = documents.transform(extract_tagged, into="tagged").transform(
        extract_phrased, into="phrased"
    )
    return both.select("doc_id", "tagged", "phrased")


def document_lengths(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return within_length(documents, "text").select(
        "doc_id", F.length("text").alias("characters")
    )


def normalized_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", normalize_text("text").alias("text")
    )


def cleaned_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", clean_completion("html").alias("cleaned")
    )


def kept_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Kept records through the JSON-lines sink, read back by partition."""
    path, run = new_folder(spark, "kept"), (_TEACHER, "orders", "boring", "train")
    write_kept(curate_kept_records(spark, folder), path, *run, compression="gzip")
    kept = read_kept(spark, path, mode="boring", subset="train")
    return kept.select(*schemas.KEPT.fieldNames(), "teacher", "dataset")


def published_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Kept records as a draft, then final, then by a publisher that is cut off."""
    root, run = new_folder(spark, "published"), (_TEACHER, "orders", "boring", "train")
    kept = written(curate_kept_records(spark, folder), "kept")
    first = publish_kept(kept.withColumn("split", F.lit("draft")), root, *run, compression="gzip")
    last = publish_kept(kept, root, *run, compression="gzip")
    write_kept(kept, f"{root}/data/publish={last + 1}", *run, compression="gzip")
    names = schemas.KEPT.fieldNames()
    old = read_published_kept(spark, root, version=first).select(F.lit("old").alias("read"), *names)
    new = read_published_kept(spark, root, mode="boring")
    return old.unionByName(new.select(F.lit("newest").alias("read"), *names))


def appended_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Orders numbered in two appends: the finished ones, then all."""
    store = new_folder(spark, "numbers")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    finished = orders.where(F.col("o_orderstatus").eqNullSafe("F"))
    append_numbers(finished, ["o_orderkey"], store, 0)
    return append_numbers(orders, ["o_orderkey"], store, 1)


def results_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "results")
    write_results(
        evaluation_results(spark, folder), path, "example/model-7b", _TEACHER, "orders", "boring"
    )
    results = read_results(spark, path, model="model-7b")
    return results.select(*schemas.RESULT.fieldNames(), "dataset", "note")


def _arrive(completions: DataFrame, folder: str) -> None:
    files = completions.coalesce(ARRIVING).write.mode("append")
    files.option("parquet.block.size", ROW_GROUP).parquet(folder)


def _arriving(spark: SparkSession, folder: str) -> DataFrame:
    return completion_stream(spark, folder, files_per_batch=2, file_format="parquet")


def _streamed(spark: SparkSession, folder: str) -> str:
    arriving, sink = new_folder(spark, "arriving"), new_folder(spark, "sink")
    _arrive(written(derived_completions(spark, folder).drop("variant"), "completions"), arriving)
    prompts = _prompts(spark, folder).drop("answer", "teacher", "mode")
    curate_stream(
        _arriving(spark, arriving),
        prompts,
        sink,
        new_folder(spark, "progress"),
    ).awaitTermination()
    return sink


def streamed_kept_records(spark: SparkSession, folder: str) -> DataFrame:
    """Kept records of a stream of completion files; equal to the batch result."""
    return streamed_kept(spark, _streamed(spark, folder))


def streamed_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Last running counts of the stream's batch metrics."""
    metrics = batch_metrics(spark, _streamed(spark, folder))
    return metrics.agg(
        F.max("running_kept").alias("kept"),
        F.max("running_total").alias("total"),
        F.max_by("running_pct", "batch_id").alias("success_pct"),
    )


def _in_two_runs(spark: SparkSession, folder: str, start: Callable, between: Callable) -> None:
    """All completions as a stream: one half, ``between()``, then a restart on the rest."""
    arriving, progress = new_folder(spark, "arriving"), new_folder(spark, "progress")
    completions = written(derived_completions(spark, folder).drop("variant"), "completions")
    half = F.pmod(F.xxhash64("problem_id", "sample_no"), F.lit(2))
    for number in (0, 1):
        _arrive(completions.where(half == number), arriving)
        start(_arriving(spark, arriving), progress).awaitTermination()
        if number == 0:
            between()


def streamed_running_success(spark: SparkSession, folder: str) -> DataFrame:
    """Success by run, kept in the state store over two runs of a stream."""
    sink, by = new_folder(spark, "sink"), ["teacher", "mode"]
    problems = written(derived_problems(spark, folder), "problems")

    def start(stream: DataFrame, progress: str):
        return running_success_stream(judge(stream, problems), by, sink, progress)

    _in_two_runs(spark, folder, start, lambda: None)
    return latest_success(spark, sink, by)


def streamed_tagged_vote(spark: SparkSession, folder: str) -> DataFrame:
    """The tagged vote from tallies of micro-batches, folded once in between."""
    sink = new_folder(spark, "sink")
    _in_two_runs(
        spark, folder,
        lambda stream, progress: vote_stream(stream, sink, progress),
        lambda: fold_votes(spark, sink),
    )
    return streamed_votes(spark, sink)


def streamed_best_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Best of n from the best of each answer and micro-batch; the gold comes last."""
    sink = new_folder(spark, "sink")
    _in_two_runs(
        spark, folder,
        lambda stream, progress: best_stream(stream, sink, progress),
        lambda: fold_best(spark, sink),
    )
    return streamed_best(spark, sink, derived_problems(spark, folder))


def late_problem_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts where half of the problems come after their completions."""
    sink, late = new_folder(spark, "sink"), new_folder(spark, "late")
    problems = written(_prompts(spark, folder).drop("answer", "teacher", "mode"), "problems")
    early = problems.where(F.col("problem_id") % 2 == 0)
    known = [early, problems]

    def start(stream: DataFrame, progress: str):
        return curate_stream(stream, known.pop(0), sink, progress)

    _in_two_runs(spark, folder, start, lambda: regrade(spark, sink, late, early))
    regrade(spark, sink, late, problems)
    return all_verdicts(spark, sink, late).select("problem_id", "sample_no", "verdict")


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        curate_kept_rate,
        curate_verdicts,
        curate_kept_records,
        curate_rejects,
        curate_from_raw,
        adapter_rows,
        template_rows,
        template_rejects,
        template_kept_rows,
        strict_parse,
        lenient_parse,
        cleaned_completions,
        tagged_answers,
        phrased_answers,
        graded_answers,
        tagged_vote,
        phrased_vote,
        best_samples,
        evaluation_results,
        evaluation_accuracy,
        evaluation_batches,
        curation_batches,
        curation_report,
        numbered_orders,
        holdout_members,
        generation_prompts,
        evaluation_prompts,
        conversation_messages,
        fanned_out,
        attached_completions,
        outstanding_prompts,
        orphan_completions,
        repeated_keys,
        training_messages,
        training_set_round_trip,
        problems_by_split,
        plain_training_messages,
        document_numbers,
        document_lengths,
        normalized_documents,
        cleaned_pages,
        kept_round_trip,
        published_versions,
        appended_numbers,
        results_round_trip,
        streamed_kept_records,
        streamed_totals,
        streamed_running_success,
        streamed_tagged_vote,
        streamed_best_samples,
        late_problem_verdicts,
    )
}
