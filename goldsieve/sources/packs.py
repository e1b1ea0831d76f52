"""Prompt packs: a small table of system prompt and user template per mode."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Pack(NamedTuple):
    stage: str
    mode: str
    system: str
    user_template: str


_BLOCKS = (
    "Answer in three lines, in this order and with nothing between them:\n"
    "<trip_before> {style} reasoning </trip_before>\n"
    "<answer> the correct answer alone </answer>\n"
    "<end> {style} closing remark </end>\n"
)
_WRAP = (
    "Problem:\n{question}\n\nCorrect answer:\n{answer}\n\n"
    "Write the three lines and put the correct answer between the answer tags."
)
_SOLVE = "Work through this problem and give its final numerical answer: {question}"

DEFAULT_PACKS = (
    Pack("generate", "boring", _BLOCKS.format(style="plain, literal"), _WRAP),
    Pack("generate", "surreal", _BLOCKS.format(style="dreamlike, associative"), _WRAP),
    Pack(
        "solve",
        "default",
        "Solve the problem step by step. Put the final answer between <answer> and </answer>.",
        _SOLVE,
    ),
    Pack("solve", "surreal", _BLOCKS.format(style="dreamlike, associative"), _SOLVE),
)


def packs_table(spark: SparkSession, packs: tuple[Pack, ...] = DEFAULT_PACKS) -> DataFrame:
    return spark.createDataFrame(
        list(packs), "stage string, mode string, system string, user_template string"
    )


def find_pack(table: DataFrame, stage: str, mode: str) -> Pack:
    """The one pack of a stage and mode."""
    wanted = table.where((F.col("stage") == stage) & (F.col("mode") == mode))
    rows = wanted.select(*Pack._fields).limit(2).collect()
    if not rows:
        raise ValueError(f"no prompt pack for stage {stage!r} and mode {mode!r}")
    if len(rows) > 1:
        raise ValueError("a pack table holds one row per stage and mode")
    return Pack(*rows[0])
