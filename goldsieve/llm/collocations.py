"""Phrase collocations by set-oriented mining over sorted occurrence relations.

Texts are cut into pieces and these into words.  The relation ``R1`` has a row for each
occurrence of a word: its place, and the word.  Places count the words of a block and one gap
per border of a piece, so *the next place* is the adjacent position of the same
piece or nothing.  The relations are persisted sorted by place, in blocks of whole
texts of one language; within a block the place is the array index.  A block is kept in rows
of ``PART_PLACES`` places, and a task works on it row by row.

For each length k:

1. merge-join ``R(k-1)`` with ``R1`` by piece and adjacent position: both are sorted, so a
   place of the one meets the place ``k - 1`` further of the other;
2. group and count: first inside a block, then all blocks' counts by phrase; what stands
   less than ``LEAST`` times goes;
3. semi-join: each block gets the phrases left that are its own.  ``R(k)`` keeps only their occurrences, and is persisted
   before the next length extends it.

A phrase of k words is the number of its head, the first k - 1, and that of its last word, so
counts are exact and no text is moved.  Frequent words are numbered; a pair's number is
those of its words; longer phrases that are extended further are numbered again.  Inside a
block phrases go by their index among the block's own.  What goes through a shuffle has one row per block and
distinct phrase; no word, phrase or language is gathered in one task.

A candidate's score is the least, over its cuts, of ``1000000 * a * a / (l * r)``, in exact
decimals.  One that stands inside a longer one, whose count is at least half of its own, goes.

Cases: a null text is empty; a null language is ``und`` and one with the row's that say so;
equal rows count each; a piece without words adds nothing; texts of any length are read
in stretches; ties in score and count are broken by the phrase's bytes; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldsieve.llm.passages import _batch, _text, stretches
from goldsieve.llm.scratch import Scratch
from goldsieve.llm.shuffles import bounded_batches, release_shuffles
from goldsieve.operators.numbering import with_row_no

LEAST = 10
LONGEST = 3
TOP = 2000
SUBSUMED_PERCENT = 50
BLOCK_WORDS = 1 << 22
# Places of a block that one row holds: rows pass through buffers that are held several times over.
PART_PLACES = 1 << 18
UNKNOWN = "und"
_IDS = 1 << 31

# The bytes that end a piece, and the letters that are lowered.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_BYTES = bytearray(range(256))
_BYTES[ord("A") : ord("Z") + 1] = bytes(range(ord("a"), ord("z") + 1))
_BYTES[ord("\t")] = ord(" ")
for _end in _ENDS:
    _BYTES[_end] = ord("\n")
_BYTES = bytes(_BYTES)


class _Codes(dict):
    """Numbers of words from 1, in the order they are met; 0 is a border of pieces."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


def occurrences(text: memoryview | bytes, codes: _Codes) -> list[np.ndarray]:
    """Codes of the words of a text by place, gaps as zeros, one at the end."""
    found = []
    for low, high in stretches(text):
        words = bytes(text[low:high]).translate(_BYTES).replace(b"\n", b" \n ").split(b" ")
        part = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
        found.append(part[part >= 0])
    return [*found, np.zeros(1, np.int32)]


_BLOCK = "block bigint, part bigint, lang string, n bigint, words binary, r1 binary, rk binary, names binary"
_BLOCK_TYPES = [("block", pa.int64()), ("part", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.binary()), ("r1", pa.binary()), ("rk", pa.binary()), ("names", pa.binary())]


def _first_relation(docs: DataFrame) -> DataFrame:
    """``R1``, with the words' codes in the block as phrases; a part has its words and, as names, their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: dict[str, tuple[_Codes, list[np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block
            for lang, (codes, parts) in held.items():
                places = np.concatenate(parts)
                gap = places == 0
                places = places[~(gap & np.concatenate(([True], gap[:-1])))]
                words = list(codes)[1:]
                for low in range(0, len(places), PART_PLACES):
                    part = places[low : low + PART_PLACES]
                    met = np.flatnonzero(np.bincount(part)[1:]) + 1
                    named = b"\n".join([words[code] for code in met.tolist()])
                    row = [block, low, lang, int((part > 0).sum()), named, None, part.tobytes(), _packed(met)]
                    yield _batch([[value] for value in row], _BLOCK_TYPES)
                block += len(places) > 0
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in held:
                    held[lang] = _Codes(), []
                codes, parts = held[lang]
                found = occurrences(_text(text), codes)
                parts += found
                size += sum(map(len, found))
                if size >= BLOCK_WORDS:
                    yield from flush()
                    size = 0
        yield from flush()

    lang = F.coalesce("lang", F.lit(UNKNOWN))
    return docs.select(lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _BLOCK)


def merge_join(r1: np.ndarray | None, rk: np.ndarray, k: int) -> np.ndarray:
    """Keys of the k-word phrases by their first place: the head's index and the last word's number."""
    keys = np.zeros(len(rk), np.int64)
    if r1 is None:
        keys[:] = rk
    else:
        count = max(0, min(len(rk), len(r1) - k + 1))
        head, last = rk[:count].astype(np.int64), r1[k - 1 : k - 1 + count].astype(np.int64)
        keys[:count] = np.where((head > 0) & (last > 0), head << 32 | last, 0)
    return keys


def _packed(names: np.ndarray) -> bytes:
    """Ascending numbers by their differences, which compress better."""
    return np.diff(names, prepend=0).astype(np.int64).tobytes()


def _relation(value: pa.Scalar) -> np.ndarray | None:
    return np.frombuffer(value.as_buffer(), np.int32) if value.is_valid else None


def _names(value: pa.Scalar) -> np.ndarray | None:
    return np.cumsum(np.frombuffer(value.as_buffer(), np.int64)) if value.is_valid else None


def _by_block(parts: list[np.ndarray], names: list[np.ndarray | None]) -> tuple[list[np.ndarray], np.ndarray | None]:
    """The parts' phrases by their index among the names of all parts, and these names."""
    if names[0] is None:
        return parts, None
    whole = np.unique(np.concatenate(names))
    indexes = (np.append(0, np.searchsorted(whole, own) + 1).astype(np.int32) for own in names)
    return [index[part] for index, part in zip(indexes, parts)], whole


def _counted(relation: DataFrame, k: int) -> DataFrame:
    """``block, head, last, n`` (``lang, word`` for single words): the counts inside each block.

    The parts of a block follow one another.  Should two tasks read them, a phrase has two
    rows, which add up like those of two blocks.
    """
    schema = [("block", pa.int64()), ("head", pa.int64()), ("last", pa.int64()), ("n", pa.int64())]
    more = [("lang", pa.string()), ("word", pa.string())] if k == 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lang, held, named = None, None, [], {}

        def flush() -> Iterator[pa.RecordBatch]:
            r1s, rks, names = zip(*held)
            held.clear()
            rks, whole = _by_block(rks, names if k > 1 else [None])
            keys = [part[part > 0] for part in (merge_join(r1, rk, k) for r1, rk in zip(r1s, rks))]
            keys = np.concatenate(keys)
            keys.sort()
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
            n = np.diff(np.append(first, len(keys)))
            keys = keys[first]
            for low in range(0, len(keys), 100_000):
                part = keys[low : low + 100_000]
                head, last = (np.zeros_like(part), part) if k == 1 else (part >> 32, part & (_IDS - 1))
                if whole is not None:
                    head = whole[head - 1]
                columns = [np.full(len(part), block), head, last, n[low : low + 100_000]]
                if k == 1:
                    columns += [[lang] * len(part), [named[code] for code in part.tolist()]]
                yield _batch(columns, schema + more)
            named.clear()

        for batch in batches:
            for own, its, words, *parts in zip(*batch.columns):
                if held and own.as_py() != block:
                    yield from flush()
                block, lang = own.as_py(), its.as_py()
                r1, rk, names = _relation(parts[0]), _relation(parts[1]), _names(parts[2])
                held.append((r1, rk, names))
                if k == 1:
                    named.update(zip(names.tolist(), words.as_py().split(b"\n")))
        if held:
            yield from flush()

    out = "block bigint, head bigint, last bigint, n bigint" + ", lang string, word string" * (k == 1)
    return relation.select("block", "lang", "words", "r1", "rk", "names").mapInArrow(run, out)


def _semi_joined(relation: DataFrame, known: DataFrame, k: int, longest: int) -> DataFrame:
    """``R(k)``: the occurrences of the phrases in ``known(block, head, last, id)``.

    Phrases are held by their index among the part's, ``names`` has their numbers; single
    words are held by their numbers.  A part's ``r1`` goes on for the ``longest - 1`` places
    that its last phrases reach into.
    """
    none, parts = F.lit(None), ("r1", "rk", "names")
    names = F.col("names") if k > 1 else none.cast("binary").alias("names")
    rows = relation.select(
        "block", none.cast("bigint").alias("head"), F.col("part").alias("last"), none.cast("bigint").alias("id"),
        "r1", "rk", names,
    ).unionByName(known.select("block", "head", "last", "id", *(none.cast("binary").alias(part) for part in parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, found = None, [], []  # the block's parts, and the phrases that followed

        def flush() -> Iterator[pa.RecordBatch]:
            at, r1s, rks, names = zip(*held)
            rks, whole = _by_block(rks, names)
            head, last, ids = (np.concatenate(column) for column in zip(*found)) if found else [np.empty(0, np.int64)] * 3
            held.clear(), found.clear()
            if whole is not None:
                head = np.searchsorted(whole, head) + 1
            keys, last = last if k == 1 else head << 32 | last, None
            if k == 1:
                rks = [_looked_up(keys, rk, ids) for rk in rks]
                whole = np.concatenate(rks)
            for low, r1, rk in zip(at, r1s, rks):
                if k == 1:
                    r1, own = whole[low : low + len(rk) + longest - 1], None
                else:
                    wanted = merge_join(r1, rk, k)
                    rk = _looked_up(keys, wanted, np.arange(1, len(keys) + 1))
                    met = np.unique(rk[rk > 0])
                    own, rk = _packed(ids[met - 1]), np.where(rk > 0, np.searchsorted(met, rk) + 1, 0).astype(np.int32)
                row = [block, low, None, None, None, r1.tobytes(), rk.tobytes(), own]
                yield _batch([[value] for value in row], _BLOCK_TYPES)

        for batch in batches:
            blocks, numbers = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            # A block's parts stand in order before its phrases, which are in order.
            heads = np.flatnonzero(batch.column(1).is_null().to_numpy(zero_copy_only=False)).tolist()
            for low, high in zip([0, *heads], [*heads, len(blocks)]):
                if low in heads and low < high:
                    if held and blocks[low] != block:
                        yield from flush()
                    block = int(blocks[low])
                    r1, rk = (_relation(batch.column(at)[low]) for at in (4, 5))
                    held.append((int(numbers[low]), r1, rk, _names(batch.column(6)[low])))
                    low += 1
                if low < high:
                    columns = (batch.column(at).slice(low, high - low) for at in (1, 2, 3))
                    found.append([column.to_numpy(zero_copy_only=False).astype(np.int64) for column in columns])
        if held:
            yield from flush()

    return rows.repartition("block").sortWithinPartitions("block", "head", "last").mapInArrow(run, _BLOCK)


def _looked_up(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of the ascending ``keys``, zero for what is not among them."""
    if not len(keys):
        return np.zeros(len(wanted), np.int32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(np.int32)


def _frequent(counts: DataFrame, least: int, *phrase: str) -> DataFrame:
    """The rows, one per block, of phrases that stand ``least`` times in all, with that count ``f``.

    A window, not an aggregate and a join: the blocks' counts are moved once.  Its
    groups have a row per block.
    """
    whole = F.sum("n").over(Window.partitionBy(*phrase))
    return counts.withColumn("f", whole).where(F.col("f") >= least).drop("n")


def _numbered(found: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Phrases with dense numbers from 1."""
    numbered = with_row_no(scratch.write(found, "frequent"), order, "id").withColumn("id", F.col("id") + 1)
    numbered = scratch.write(numbered, "phrases")
    if numbered.count() >= _IDS:
        raise ValueError(f"{_IDS} or more frequent phrases of one length: raise the least count")
    return numbered


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``lang, ids, phrase, f`` of all phrases that stand ``least`` times, and ``lang, n``."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch("collocations")
    relation = scratch.write(_first_relation(docs), "r1")
    sizes = scratch.write(relation.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    # Of each frequent phrase one row per block; the others end in the window.
    near = scratch.write(_frequent(_counted(relation, 1), least, "lang", "word"), "c1")
    release_shuffles(docs.sparkSession)
    words = _numbered(near.groupBy("lang", "word").agg(F.first("f").alias("f")), ["lang", "word"], scratch)
    level = words.select("id", "lang", F.array("id").alias("ids"), F.col("word").alias("phrase"), "f")
    levels, known = [level], near.join(words, ["lang", "word"]).select("block", "head", "last", "id")
    for k in range(2, longest + 1):
        smaller = scratch.write(_semi_joined(relation, known, k - 1, longest), "r")
        scratch.drop(relation, near)
        relation = smaller
        counts = _counted(relation, k)
        if k < longest:
            near = scratch.write(_frequent(counts, least, "head", "last"), "c")
            frequent = near.groupBy("head", "last").agg(F.first("f").alias("f"))
        else:
            total = counts.groupBy("head", "last").agg(F.sum("n").alias("f"))
            near = frequent = scratch.write(total.where(F.col("f") >= least), "c")
        release_shuffles(docs.sparkSession)
        if k == 2:
            pair = F.shiftleft("head", 32).bitwiseOR(F.col("last"))
            numbered, known = frequent.withColumn("id", pair), near.withColumn("id", pair)
        else:
            numbered = _numbered(frequent, ["head", "last"], scratch)
            known = near.join(numbered.select("head", "last", "id"), ["head", "last"])
        known = known.select("block", "head", "last", "id") if k < longest else None
        named = numbered.join(level.select(F.col("id").alias("head"), "lang", "ids", "phrase"), "head").join(
            words.select(F.col("id").alias("last"), "word"), "last"
        )
        level = scratch.write(
            named.select(
                "id", "lang", F.concat("ids", F.array("last")).alias("ids"),
                F.concat_ws(" ", "phrase", "word").alias("phrase"), "f",
            ),
            "level",
        )
        levels.append(level)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    found = scratch.write(found.select("lang", "ids", "phrase", "f"), "all")
    scratch.drop(relation, near)
    return found, sizes


def score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 * a * a / (l * r))`` in decimals, exact for counts below 10 ** 15."""
    a, left, right = (count.cast("decimal(15,0)") for count in (a, left, right))
    whole = F.lit(1_000_000).cast("decimal(7,0)") * (a * a)
    return F.call_function("div", whole, left * right).cast("bigint")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases."""
    found, sizes = frequent_phrases(docs, least, longest)
    counts = found.select("ids", "f")
    several = found.where(F.size("ids") >= 2).select("lang", "ids", "phrase", F.col("f").alias("a"))
    cuts = several.select(
        "ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")
    ).select("ids", "a", "k", F.slice("ids", 1, F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, F.size("ids")).alias("rest"))
    judged = (
        cuts.join(counts.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first")
        .join(counts.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
        .groupBy("ids")
        .agg(F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))
    )
    inner = several.where(F.size("ids") >= 3).select(
        "a", F.size("ids").alias("size"), "ids", F.explode(F.sequence(F.lit(2), F.size("ids") - 1)).alias("width")
    )
    inner = inner.select("a", "ids", "width", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("width") + 1)).alias("at"))
    longer = (
        inner.select("a", F.slice("ids", F.col("at"), F.col("width")).alias("ids"))
        .groupBy("ids")
        .agg(F.max("a").alias("above"))
    )
    subsumed = F.coalesce(100 * F.col("above") >= SUBSUMED_PERCENT * F.col("a"), F.lit(False))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        several.join(judged, "ids")
        .join(longer, "ids", "left")
        .where(~subsumed)
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        .withColumn("rank", F.row_number().over(best).cast("bigint"))
        .where(F.col("rank") <= top)
        .join(sizes, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
