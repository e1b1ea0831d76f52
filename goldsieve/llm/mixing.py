"""Mixing sources to target weights by Sainte-Lague apportionment of token blocks.

A source's documents, in a fixed order, form one stream of words that is cut
into blocks of ``BLOCK_WORDS``.  The words of the mix are split over the sources
by weight, never above ``repeats`` times a source's own words.  As many blocks as
the mix has room for are seats: sources get them by highest quotients of their
targets, and a source's shards get its seats by highest quotients of their
blocks.  Within a shard a seeded permutation of the block numbers says which
blocks are taken; each block is taken ``quota // blocks`` times or once more.

Nothing is ranked or moved to choose blocks: a block's fate is a function of its
number.  A source of any size is spread over ``BUCKETS`` of two narrow
shuffles; what meets in one task is one row per source.

Cases: a null source is a source of its own, the last in order; a null or empty
text has no words and takes none; rows with equal key, source and size are
interchangeable, so reruns agree as a set; an empty table gives an empty result;
other columns are neither read nor changed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldsieve.durable import written

BLOCK_WORDS = 128
BUCKETS = 256
SHARDS = 64
WEIGHTS = (5, 2, 1)
# Multipliers of the permutations, primes above any shard's block count.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def n_words(text: Column) -> Column:
    """Words of ``[^ \\t-\\r]+``; 0 for null."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"[\x20\x09-\x0D]+"))).cast("bigint")


def _digest(start: int, length: int, *parts: Column) -> Column:
    """Hex digits of the parts' md5 as a number."""
    text = F.concat_ws("|", *(F.coalesce(part.cast("string"), F.lit("")) for part in parts))
    return F.conv(F.substring(F.md5(text), start, length), 16, 10).cast("bigint")


def targets(sources: DataFrame, share: float, repeats: int) -> DataFrame:
    """Add ``target`` to ``sources(key, source_size)``: weights in turn, capped.

    The common rate is what remains after the sources that stop at their cap,
    in ascending order of cap per weight; it is the first rate that no longer
    fills its own source.
    """
    weight = F.element_at(
        F.array(*map(F.lit, WEIGHTS)),
        (F.row_number().over(Window.orderBy("key")) - 1) % len(WEIGHTS) + 1,
    ).cast("double")
    ranked = sources.withColumn("weight", weight).withColumn(
        "cap", F.col("source_size") * float(repeats)
    )
    whole = Window.partitionBy()
    earlier = Window.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = F.sum("source_size").over(whole) * float(share) - F.coalesce(
        F.sum("cap").over(earlier), F.lit(0.0)
    )
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    tried = ranked.withColumn("rate", left / weights)
    fits = F.col("rate") * F.col("weight") <= F.col("cap")
    rate = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "key", "rate"))).over(whole)
    open_target = F.coalesce(rate["rate"] * F.col("weight"), F.col("cap"))
    return tried.select(
        "key", "source_size", F.least(open_target, F.col("cap")).alias("target")
    )


def highest_quotients(parts: DataFrame, group: list[str], key: str) -> DataFrame:
    """Add ``quota``: the group's ``seats`` split over its rows by ``share``.

    Sainte-Lague gives a row ``share / d`` rounded, for one divisor d of the
    group, and rounding n rows moves their sum by n / 2 at most.  So a quota lies
    within ``n / 2`` times the row's portion, plus one, of the exact part, and
    only the quotients in that band, about 3 n of them, are bid and compared.
    """
    whole = Window.partitionBy(*group)
    portion = F.coalesce(F.col("share") / F.nullif(F.sum("share").over(whole), F.lit(0.0)), F.lit(0.0))
    spread = F.ceil(portion * F.count(F.lit(1)).over(whole) / 2) + 2
    exact = F.floor(portion * F.col("seats"))
    banded = parts.select(
        "*",
        F.greatest(exact - spread, F.lit(0)).alias("low"),
        F.when(F.col("share") > 0, exact + spread).otherwise(F.lit(0)).alias("high"),
    ).select("*", (F.col("seats") - F.sum("low").over(whole)).alias("left"))
    bids = banded.select(
        "*", F.explode(F.sequence(F.col("low"), F.greatest("low", "high"))).alias("seat")
    )
    # The bid at ``low`` only keeps the row: it is no quotient.
    quotient = F.when(F.col("seat") > F.col("low"), F.col("share") / (2 * F.col("seat") - 1))
    order = Window.partitionBy(*group).orderBy(quotient.desc_nulls_last(), key, "seat")
    won = (F.col("seat") > F.col("low")) & (F.row_number().over(order) <= F.col("left"))
    return (
        bids.withColumn("won", won.cast("int"))
        .groupBy(*parts.columns, "low")
        .agg(F.sum("won").alias("won"))
        .select(*parts.columns, (F.col("low") + F.col("won")).alias("quota"))
    )


def plan_mix(docs: DataFrame, share: float = 1.5, repeats: int = 2, seed: int = 1) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, picks``.

    ``picks`` lists the blocks that the document touches: how many words of the
    block are its own, and how often the mix takes the block.
    """
    key = F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b"))
    sized = written(
        docs.select(
            "doc_id",
            "source",
            n_words(F.col("text")).alias("size"),
            key.alias("key"),
            _digest(1, 2, F.col("doc_id")).alias("bucket"),
        ),
        "mix",
    )
    by_key = Window.partitionBy("key")
    buckets = (
        sized.groupBy("key", "bucket")
        .agg(F.sum("size").alias("in_bucket"))
        .select(
            "key",
            "bucket",
            (F.sum("in_bucket").over(by_key.orderBy("bucket")) - F.col("in_bucket")).alias("before"),
            F.sum("in_bucket").over(by_key).alias("source_size"),
        )
    )
    sources = targets(buckets.select("key", "source_size").distinct(), share, repeats)
    seats = F.round(F.sum("target").over(Window.partitionBy()) / BLOCK_WORDS).cast("bigint")
    seated = highest_quotients(
        sources.select("*", F.col("target").alias("share"), seats.alias("seats"), F.lit(0).alias("all")),
        ["all"],
        "key",
    ).select("key", "source_size", "target", F.col("quota").alias("seats"))
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
    shards = seated.select("*", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard")).select(
        "*", F.floor((blocks + (SHARDS - 1) - F.col("shard")) / SHARDS).alias("blocks")
    ).withColumn("share", F.col("blocks").cast("double"))
    primes = F.array(*(F.lit(prime).cast("bigint") for prime in PRIMES))
    seeded = F.lit(seed), F.col("key"), F.col("shard")
    quotas = (
        highest_quotients(shards, ["key"], "shard")
        .select(
            "key",
            "target",
            F.struct(
                "shard",
                "blocks",
                "quota",
                F.element_at(primes, (_digest(1, 4, *seeded) % len(PRIMES) + 1).cast("int")).alias("step"),
                _digest(5, 8, *seeded).alias("shift"),
            ).alias("shard"),
        )
        .groupBy("key", "target")
        .agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    )
    places = buckets.join(quotas, "key")
    running = Window.partitionBy("key", "bucket").orderBy("doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = (
        sized.withColumn("inside", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .join(places, ["key", "bucket"])
        .withColumn("first", F.col("before") + F.col("inside"))
    )
    first, end = F.col("first"), F.col("first") + F.col("size")

    def pick(block: Column) -> Column:
        at = F.element_at("shards", (block % SHARDS + 1).cast("int"))
        turn = (at["step"] * F.floor(block / SHARDS) + at["shift"]) % F.greatest(at["blocks"], F.lit(1))
        more = (turn < at["quota"] % F.greatest(at["blocks"], F.lit(1))).cast("bigint")
        words = F.least(end, (block + 1) * BLOCK_WORDS) - F.greatest(first, block * BLOCK_WORDS)
        times = F.floor(at["quota"] / F.greatest(at["blocks"], F.lit(1))) + more
        return F.struct(words.alias("words"), F.least(times, F.lit(repeats)).alias("times"))

    touched = F.sequence(F.floor(first / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS))
    picks = F.when(F.col("size") > 0, F.transform(touched, pick)).otherwise(F.array())
    taken = F.aggregate("picks", F.lit(0).cast("bigint"), lambda sum_, p: sum_ + p["words"] * p["times"])
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", picks.alias("picks")
    ).select("*", taken.alias("taken"))


def mixed_documents(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The texts of the mix, with the columns of ``docs``.

    A document taken whole comes as it is, once per time taken.  Of one whose
    blocks are taken in part, each copy has the taken stretches of words, a line
    each, and ``n_chars`` says its new length.  Rows that agree in key, source
    and size all get the least of their plans, on every run.  Other columns may have any
    names.
    """
    keys, own = ["doc_id", "source", "size"], f"mix_{uuid.uuid4().hex}"
    picks = plan.where("taken > 0").groupBy(*keys).agg(F.min("picks").alias("picks"))
    picks = picks.select(*(F.col(name).alias(f"{own}_{name}") for name in [*keys, "picks"]))
    match = (
        F.col("doc_id").eqNullSafe(F.col(f"{own}_doc_id"))
        & F.col("source").eqNullSafe(F.col(f"{own}_source"))
        & (n_words(F.col("text")) == F.col(f"{own}_size"))
    )
    joined = docs.join(picks, match).select(*(F.col(f"`{name}`") for name in docs.columns), f"{own}_picks")
    names, text_at = docs.columns, docs.columns.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, lengths = [], [], []
            for row, (text, picks) in enumerate(zip(batch.column(text_at), batch.column(len(names)))):
                text, picks = text.as_py(), picks.as_py()
                for copy in range(1, 1 + max(p["times"] for p in picks)):
                    piece = _taken(text, picks, copy)
                    rows.append(row)
                    texts.append(piece)
                    lengths.append(len(piece))
            columns = [column.take(pa.array(rows, pa.int64())) for column in batch.columns[: len(names)]]
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if chars_at is not None:
                columns[chars_at] = pa.array(lengths).cast(columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut, docs.schema)


def _taken(text: str, picks: list[dict], copy: int) -> str:
    """The stretches of ``text`` whose blocks are taken at least ``copy`` times."""
    if all(p["times"] >= copy for p in picks):
        return text
    spans = [found.span() for found in _WORD.finditer(text)]
    pieces: list[tuple[int, int, int]] = []
    at = 0
    for p in picks:
        if p["times"] >= copy:
            start, end = spans[at][0], spans[at + p["words"] - 1][1]
            if pieces and pieces[-1][2] == at:
                pieces[-1] = (pieces[-1][0], end, at + p["words"])
            else:
                pieces.append((start, end, at + p["words"]))
        at += p["words"]
    return "\n".join(text[start:end] for start, end, _ in pieces)


def source_mix(docs: DataFrame, share: float = 1.5, repeats: int = 2, seed: int = 1) -> DataFrame:
    return plan_mix(docs, share, repeats, seed).select(
        "doc_id", "size", "source_size", "target", "taken"
    )
