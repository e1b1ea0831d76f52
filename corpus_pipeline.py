"""From raw documents to packed training tokens, in five stages.

Each stage works on all that its predecessor kept: documents that the quality
trees reject go; of each group of near copies one document stays; documents with
a benchmark passage go; the sources are mixed to their target weights, whole
documents or stretches of them, up to twice; and the mix is written as token
packs in key order and read back.

Near copies are judged on five-word shingles at a similarity of 0.8 or more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from goldsieve.durable import written
from goldsieve.llm.decontamination import drop_contaminated
from goldsieve.llm.minhash import drop_near_duplicates
from goldsieve.llm.mixing import mixed_documents, plan_mix
from goldsieve.llm.quality_trees import fit_quality, keep_quality
from goldsieve.llm.queries import TOKENIZER
from goldsieve.llm.shuffles import bounded_batches, release_shuffles
from goldsieve.llm.token_packs import packed_tokens
from goldsieve.sources.derived import table

SHINGLE_WORDS = 5
# What a task hands to Python at once: five stages share one executor's memory.
BATCH_BYTES = "4m"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, SHINGLE_WORDS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, plan_mix(docs))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_tokens(docs, TOKENIZER)


def _in_bounds(stage: Stage) -> Stage:
    """The stage, after the shuffle files of earlier ones, with small batches."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_shuffles(spark)
        bounded_batches(spark, BATCH_BYTES)
        found = stage(spark, docs, sf_dir)
        bounded_batches(spark, BATCH_BYTES)  # what the caller runs, whatever the stage set
        return found

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", _in_bounds(accept_quality)),
    ("near-duplicates", _in_bounds(drop_copies)),
    ("benchmark decontamination", _in_bounds(drop_leaks)),
    ("source mix", _in_bounds(mix_sources)),
    ("token packs", _in_bounds(pack_tokens)),
]

# Boosted trees, signatures and the tokenizer are not SQL; the tests compare run()
# with brute force, stage by stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
