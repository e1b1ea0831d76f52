"""Rendering chat messages from prompt packs."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldsieve.operators.completions import require_unique
from goldsieve.sources.packs import Pack, find_pack

# Which stage's packs serve a purpose.
_STAGES = {"generate": "generate", "train": "solve", "eval": "solve"}
# Up to so many characters of packs are sent to the tasks.
BROADCAST_CHARACTERS = 4_000_000


@dataclass(frozen=True)
class RoleMarkers:
    """Text put around a message; ``{role}`` stands for its role."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"

    def open(self, role: str) -> str:
        return self.before.replace("{role}", role)


def _pieces(template: str) -> list[tuple[str, str]]:
    """A template as (literal, placeholder) pairs."""
    return [(text, field or "") for text, field, _, _ in string.Formatter().parse(template)]


def _filled(pieces: list[tuple[Column, Column | None]]) -> Column:
    parts = [part for piece in pieces for part in piece if part is not None]
    return F.concat(*parts) if parts else F.lit("")


def _slot(name: str, slots: dict[str, Column]) -> Column | None:
    if not name:
        return None
    if name not in slots:
        raise ValueError(f"unknown placeholder {{{name}}} in a user template")
    return slots[name]


def _one_pack(pack: Pack, slots: dict[str, Column]) -> tuple[Column, Column]:
    pieces = [(F.lit(text), _slot(name, slots)) for text, name in _pieces(pack.user_template)]
    return F.lit(pack.system), _filled(pieces)


def _joined_packs(
    df: DataFrame, packs: DataFrame, stage: str, mode: str, slots: dict[str, Column]
) -> tuple[DataFrame, Column, Column]:
    """Look the pack up by the ``mode`` column.

    Templates are cut at their placeholders, so filling one is a plain
    concatenation and inserted text is never expanded again.  A small pack table,
    told by its characters, is sent to the rows, which stay where they are: dealt by
    mode, all rows of a mode would meet in one task.  Of a larger one the size that
    Spark finds decides.
    """
    wanted = packs.where(F.col("stage") == stage)
    require_unique(wanted, "mode")
    # Doubled braces stand for one.  Literals and slot names alternate between marks.
    opened = F.replace(F.col("user_template"), F.lit("{{"), F.lit("\x02"))
    named = F.regexp_replace(opened, rf"\{{({'|'.join(slots)})\}}", "\x01$1\x01")
    marked = F.replace(named, F.lit("}}"), F.lit("\x03"))
    if wanted.where(F.rlike(marked, F.lit(r"\{[^{}]*\}"))).limit(1).count():
        raise ValueError("unknown placeholder in a user template")
    table = wanted.select(
        F.col("mode").alias("_mode"),
        F.col("system").alias("_system"),
        F.split(marked, "\x01", -1).alias("_parts"),
    )
    length = F.length("mode") + F.length("system") + F.length("user_template")
    characters = wanted.agg(F.sum(F.coalesce(length, F.lit(0)))).first()[0] or 0
    few = characters <= BROADCAST_CHARACTERS
    joined = df.join(F.broadcast(table) if few else table, F.col(mode) == F.col("_mode"))

    def part(text: Column, at: Column) -> Column:
        chosen = F.translate(text, "\x02\x03", "{}")
        for name, column in slots.items():
            chosen = F.when((at % 2 == 1) & (text == name), column).otherwise(chosen)
        return chosen

    filled = F.transform("_parts", part)
    user = F.when(~F.exists(filled, lambda text: text.isNull()), F.array_join(filled, ""))
    return joined, F.col("_system"), user


def rows_without_pack(df: DataFrame, packs: DataFrame, purpose: str, mode_column: str) -> DataFrame:
    """Rows that :func:`render_messages` leaves out, with their ``reject_reason``."""
    stage = _STAGES[purpose]
    known = packs.where(F.col("stage") == stage).select(F.col("mode").alias("_mode"))
    return df.join(known, F.col(mode_column) == F.col("_mode"), "left_anti").withColumn(
        "reject_reason", F.lit("no_pack")
    )


def render_messages(
    df: DataFrame,
    packs: DataFrame,
    purpose: str,
    mode: str | None = None,
    mode_column: str | None = None,
    question: str = "question",
    gold: str = "golden_answer",
    target: str = "assistant_target",
    markers: RoleMarkers = RoleMarkers(),
) -> DataFrame:
    """Add ``messages`` and their text form ``prompt``.

    ``generate`` shows question and gold, ``eval`` the question, ``train`` the
    question and the target.  The pack is chosen by ``mode``, or row by row by
    ``mode_column``.  A ``mode`` without a pack is an error; rows whose column
    names none are left out, and :func:`rows_without_pack` has them.  The text
    form invites an assistant turn except for ``train``, which already has one.
    """
    if purpose not in _STAGES:
        raise ValueError(f"purpose must be one of {sorted(_STAGES)}, not {purpose!r}")
    if (mode is None) == (mode_column is None):
        raise ValueError("give either mode or mode_column")
    stage = _STAGES[purpose]
    slots = {"question": F.col(question)}
    if purpose == "generate":
        slots["answer"] = F.col(gold)

    if mode is not None:
        joined, (system, user) = df, _one_pack(find_pack(packs, stage, mode), slots)
    else:
        joined, system, user = _joined_packs(df, packs, stage, mode_column, slots)

    turns = [("system", system), ("user", user)]
    if purpose == "train":
        turns.append(("assistant", F.col(target)))
    messages = F.array(
        *(F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in turns)
    )
    parts = [
        part
        for n, (role, _) in enumerate(turns)
        for part in (
            F.lit(markers.open(role)),
            F.col("messages")[n]["content"],
            F.lit(markers.after),
        )
    ]
    if purpose != "train":
        parts.append(F.lit(markers.open("assistant")))
    return (
        joined.withColumn("messages", messages)
        .withColumn("prompt", F.concat(*parts))
        .select(*df.columns, "messages", "prompt")
    )
