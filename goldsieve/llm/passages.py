"""Repeated passages across all documents, from FM-indexes of content shards.

A *window* is ``WINDOW`` consecutive words of one document; every word that some window
covers which also starts elsewhere, in any document, is removed.

*Routing.*  A window's anchor is the leftmost of its least-hashed grams (``GRAMS[0]``
words).  It depends on the window alone, so equal windows have equal anchors.
Neighbouring windows with one anchor are a block; the words that a block's windows span
are its segment.  A window is in one block only.  Grams that anchor one block in the
whole corpus have no partner and go no further.  Equal segments are counted where they
are found, so a passage that a third of all documents share is one row per task.

*Shards.*  All blocks of a gram go to one shard, by the gram's hash; the number of
shards follows from the words that are left.  A shard is an FM-index
(:mod:`goldsieve.llm.fm_index`) of its distinct segments; one that stands twice or more is put
in twice, enough to witness a repeat.  The segments are then streamed against the index by
backward search, and each run of places with matching statistics of ``WINDOW`` or more is
an interval of repeated windows.  The symbols are the words themselves, not hashes of them.

*Hot grams.*  A gram with more than ``HOT`` distinct segments, such as the words around the
edge of a very common passage, is not held by one shard.  Its windows are cut anew by
anchors of more words; the last of ``GRAMS`` is a whole window, of which the distinct
segments are one.  Nothing is dropped on the way.

Segments are told apart by two 64-bit hashes, their gram's and their own.

Cases: a null text has no words; a text with fewer words than a window keeps all of
them; overlapping repeats in one text count; equal rows repeat each other, and so do
rows that share a key; null keys are kept; texts of any length are read in stretches;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.durable import written
from goldsieve.llm.fm_index import Index
from goldsieve.llm.shuffles import release_shuffles
from goldsieve.llm.suffixes import Stretch, _mixed, window_minima

WINDOW = 35
GRAMS = (8, 20, 35)
HOT = 1000
SHARD_WORDS = 400_000
STRETCH_BYTES = 1 << 20
STRETCH_WINDOWS = 1 << 19
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a text."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANKS[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def stretches(text: memoryview | bytes) -> Iterator[tuple[int, int]]:
    """Byte ranges of a text that end at blanks, of ``STRETCH_BYTES`` or one word more."""
    low, size = 0, len(text)
    while low < size:
        found = _BLANK.search(text, min(low + STRETCH_BYTES, size))
        high = found.end() if found else size
        yield low, high
        low = high


def word_hashes(text: memoryview | bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    found = []
    for low, high in stretches(text):
        data = np.frombuffer(text, np.uint8, high - low, low)
        starts, ends = word_spans(data)
        if len(starts):
            found.append(Stretch(data).hashes(starts, ends))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


class Runs:
    """Hashes of runs of words; the same words give the same hash anywhere."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, words: np.ndarray):
        if len(Runs._powers) <= len(words):
            size = max(len(words) + 1, 1 << 14)
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(Runs, name, np.multiply.accumulate(powers))
        self._sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * Runs._powers[: len(words)], out=self._sums[1:])

    def hashes(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        return _mixed((self._sums[ends] - self._sums[starts]) * Runs._inverses[starts])


def blocks(words: np.ndarray, gram: int, window: int = WINDOW) -> Iterator[tuple[np.ndarray, ...]]:
    """``g, s, first, last``: anchor gram and segment hash, and the windows of each block."""
    windows = len(words) - window + 1
    for low in range(0, windows, STRETCH_WINDOWS):
        part = words[low : min(low + STRETCH_WINDOWS, windows) + window - 1]
        runs = Runs(part)
        grams = runs.hashes(slice(0, len(part) - gram + 1), slice(gram, None))
        keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        anchor = (window_minima(keyed, window - gram + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.append(first[1:], len(anchor)) - 1
        segment = runs.hashes(first, last + window) ^ _mixed((last - first).astype(np.uint64))
        yield grams[anchor[first]].view(np.int64), segment.view(np.int64), first + low, last + low


def _named(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``doc, row``: the key, and a 64-bit hash of the text.

    Equal rows have equal names: what is repeated in one is repeated in the other.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text.alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64(text).alias("row"),
    )


def _text(value: pa.Scalar) -> memoryview | bytes:
    return memoryview(value.as_buffer()) if value.is_valid and value.as_buffer() is not None else b""


def _batch(columns: list, schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, (_, kind) in zip(columns, schema)], [name for name, _ in schema]
    )


_CUT = [("doc", pa.int64()), ("row", pa.int64()), ("g", pa.int64()), ("s", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]


def _all_blocks(named: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for g, s, first, last in blocks(word_hashes(_text(text)), gram, window):
                    held.append([np.full(len(g), doc), np.full(len(g), row), g, s, first, last])
                    size += len(g)
                if size > 100_000:
                    yield _batch([np.concatenate(column) for column in zip(*held)], _CUT)
                    held, size = [], 0
            if held:
                yield _batch([np.concatenate(column) for column in zip(*held)], _CUT)

    # A window has a byte for each word and a blank between them.
    texts = named.where(F.octet_length("text") >= 2 * window - 1).select("doc", "row", "text")
    return texts.mapInArrow(run, "doc bigint, row bigint, g bigint, s bigint, first int, last int")


def _segments(named: DataFrame, units: DataFrame, window: int) -> DataFrame:
    """``g, s, copies, words``: the words of each unit, cut from the document it was met in."""
    lists = units.groupBy("at.doc", "at.row").agg(
        F.collect_list(F.struct("g", "s", "copies", "at.first", "at.last")).alias("units")
    )
    schema = [("g", pa.int64()), ("s", pa.int64()), ("copies", pa.int64()), ("words", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(*batch.columns):
                wanted = sorted(wanted.as_py(), key=lambda unit: unit["first"])
                text, rows = _text(text), []
                spans = [(low, *word_spans(np.frombuffer(text, np.uint8, high - low, low))) for low, high in stretches(text)]
                starts = np.concatenate([starts + low for low, starts, _ in spans])
                ends = np.concatenate([ends + low for low, _, ends in spans])
                for unit in wanted:
                    part = bytes(text[starts[unit["first"]] : ends[unit["last"] + window - 1]])
                    rows.append((unit["g"], unit["s"], unit["copies"], b" ".join(part.split())))
                for low in range(0, len(rows), 20_000):
                    yield _batch(list(zip(*rows[low : low + 20_000])), schema)

    # Equal rows have one name; one of them is enough to cut from.
    texts = named.select("doc", "row", "text").dropDuplicates(["doc", "row"])
    return texts.join(lists, ["doc", "row"]).select("text", "units").mapInArrow(
        run, "g bigint, s bigint, copies bigint, words binary"
    )


class _Codes(dict):
    """Numbers of words from 1, in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def repeated_windows(segments: list[bytes], twice: list[bool], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each segment the intervals of windows that the shard holds at least twice."""
    codes = _Codes()
    held = [np.fromiter(map(codes.__getitem__, words.split(b" ")), np.int64) for words in segments]
    closed = [np.append(part, 0) for part in held]
    again = [part for part, more in zip(closed, twice) if more]
    symbols = np.concatenate(closed)
    ends = np.cumsum([len(part) for part in closed]) - 1
    starts = ends - [len(part) for part in held]
    index = Index(np.concatenate((symbols, *again)), len(codes) + 1)
    repeated = index.matching(symbols, starts, ends) >= window
    # Separators are no places, so runs never go from one segment into the next.
    edges = np.flatnonzero(np.diff(np.concatenate(([False], repeated, [False])).astype(np.int8)))
    first, last = edges[::2], edges[1::2] - 1
    owner = np.searchsorted(starts, first, side="right") - 1
    found: list[list[tuple[int, int]]] = [[] for _ in segments]
    for at, low, high in zip(owner.tolist(), (first - starts[owner]).tolist(), (last - starts[owner]).tolist()):
        found[at].append((low, high))
    return found


_RANGE = pa.struct([("low", pa.int32()), ("high", pa.int32())])
_FOUND = "g bigint, s bigint, ranges array<struct<low int, high int>>"


def _searched(segments: DataFrame, shards: int, window: int) -> DataFrame:
    """``g, s, ranges`` of the segments with a repeated window; one index at a time in a task."""
    schema = [("g", pa.int64()), ("s", pa.int64()), ("ranges", pa.list_(_RANGE))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            found = repeated_windows([row[3] for row in rows], [row[2] > 1 for row in rows], window)
            out = [
                (g, s, [{"low": low, "high": high} for low, high in ranges])
                for (g, s, _, _), ranges in zip(rows, found)
                if ranges
            ]
            if out:
                yield _batch(list(zip(*out)), schema)

        for batch in batches:
            for number, *row in zip(*(column.to_pylist() for column in batch.columns)):
                if number != shard and rows:
                    yield from flush()
                    rows = []
                shard = number
                rows.append(row)
        if rows:
            yield from flush()

    dealt = segments.select(F.pmod("g", F.lit(shards)).alias("shard"), "g", "s", "copies", "words")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, _FOUND)


def _recut(segments: DataFrame, window: int, gram: int) -> DataFrame:
    """Blocks of longer grams of the hot segments: ``g, s, copies`` with ``up_g, up_s, offset``."""
    schema = [("up_g", pa.int64()), ("up_s", pa.int64()), ("offset", pa.int32()), ("g", pa.int64()), ("s", pa.int64()), ("copies", pa.int64()), ("words", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for up_g, up_s, copies, text in zip(*(column.to_pylist() for column in batch.columns)):
                words = text.split(b" ")
                for g, s, first, last in blocks(word_hashes(text), gram, window):
                    for one in zip(g.tolist(), s.tolist(), first.tolist(), last.tolist()):
                        part = b" ".join(words[one[2] : one[3] + window])
                        rows.append((up_g, up_s, one[2], one[0], one[1], copies, part))
            if rows:
                yield _batch(list(zip(*rows)), schema)

    return segments.mapInArrow(
        run, "up_g bigint, up_s bigint, offset int, g bigint, s bigint, copies bigint, words binary"
    )


def _solved(segments: DataFrame, window: int, grams: tuple[int, ...]) -> DataFrame:
    """``g, s, ranges`` of distinct segments ``g, s, copies, words``."""
    sizes = written(segments.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "hot")
    hot = sizes.limit(1).count() > 0 and len(grams) > 1
    cool = segments.join(sizes.select("g"), "g", "left_anti") if hot else segments
    total = cool.agg(F.sum(F.least("copies", F.lit(2)) * F.octet_length("words") / 6)).first()[0]
    found = _searched(cool, int((total or 0) // SHARD_WORDS) + 1, window)
    if not hot:
        return found
    cut = written(_recut(segments.join(sizes.select("g"), "g", "left_semi").select("g", "s", "copies", "words"), window, grams[1]), "recut")
    finer = cut.groupBy("g", "s").agg(F.sum("copies").alias("copies"), F.min("words").alias("words"))
    inner = written(_solved(written(finer, "finer"), window, grams[1:]), "finer-found")
    back = (
        cut.join(inner, ["g", "s"])
        .select("up_g", "up_s", "offset", F.explode("ranges").alias("range"))
        .groupBy(F.col("up_g").alias("g"), F.col("up_s").alias("s"))
        .agg(
            F.collect_list(
                F.struct((F.col("range.low") + F.col("offset")).alias("low"), (F.col("range.high") + F.col("offset")).alias("high"))
            ).alias("ranges")
        )
    )
    return found.unionByName(back)


def repeated_ranges(docs: DataFrame, window: int = WINDOW, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """``doc, row, low, high``: ranges of windows that also start elsewhere."""
    named = _named(docs)
    met = written(_all_blocks(named, window, grams[0]), "blocks")
    # Written first: the join then reads two plain exchanges, of which a hot gram's is split.
    shared = written(met.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "shared")
    live = written(met.join(shared, "g", "left_semi"), "live")
    release_shuffles(docs.sparkSession)
    units = live.groupBy("g", "s").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "row", "first", "last")).alias("at")
    )
    segments = written(_segments(named, written(units, "units"), window), "segments")
    release_shuffles(docs.sparkSession)
    found = written(_solved(segments, window, grams), "found")
    release_shuffles(docs.sparkSession)
    return live.join(found, ["g", "s"]).select("doc", "row", "first", F.explode("ranges").alias("range")).select(
        "doc", "row", (F.col("first") + F.col("range.low")).alias("low"), (F.col("first") + F.col("range.high")).alias("high")
    )


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def without_passages(docs: DataFrame, window: int = WINDOW, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """``doc_id``, counts, ``kept_sha256`` and the ``kept`` words of every row of ``docs``."""
    found = repeated_ranges(docs, window, grams).distinct().groupBy("doc", "row").agg(
        F.collect_list(F.struct("low", "high")).alias("ranges")
    )
    found = written(found, "ranges")
    release_shuffles(docs.sparkSession)
    names = [part.split()[0] for part in RESULT.split(", ")]
    schema = list(zip(names, [pa.int64()] * 4 + [pa.string(), pa.binary()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for key, text, ranges in zip(*batch.columns):
                text = _text(text)
                gone = _covered(ranges, window) if ranges.is_valid else (np.empty(0, np.int64),) * 2
                count, kept = _kept(text, *gone)
                removed = int((gone[1] - gone[0]).sum())
                out.append((key.as_py(), count, removed, len(gone[0]), hashlib.sha256(kept).hexdigest(), kept))
                size += len(kept)
                if size > STRETCH_BYTES:
                    yield _batch(list(zip(*out)), schema)
                    out, size = [], 0
            if out:
                yield _batch(list(zip(*out)), schema)

    return _named(docs).join(found, ["doc", "row"], "left").select("doc_id", "text", "ranges").mapInArrow(run, RESULT)


def _covered(ranges: pa.ListScalar, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the words that ranges of windows cover, ends exclusive."""
    low = ranges.values.field("low").to_numpy().astype(np.int64)
    order = np.argsort(low, kind="stable")
    low = low[order]
    high = np.maximum.accumulate(ranges.values.field("high").to_numpy().astype(np.int64)[order] + window)
    opens = np.concatenate(([True], low[1:] > high[:-1]))
    return low[opens], high[np.append(np.flatnonzero(opens)[1:] - 1, len(high) - 1)]


def _kept(text: memoryview | bytes, low: np.ndarray, high: np.ndarray) -> tuple[int, bytes]:
    """Number of words, and those outside the runs, joined by one blank."""
    count, parts = 0, []
    for start, stop in stretches(text):
        words = bytes(text[start:stop]).split()
        if len(low):
            stay = np.ones(len(words), bool)
            first, last = np.searchsorted(high, count, "right"), np.searchsorted(low, count + len(words), "left")
            for a, b in zip(low[first:last].tolist(), high[first:last].tolist()):
                stay[max(0, a - count) : max(0, b - count)] = False
            parts += [words[at] for at in np.flatnonzero(stay).tolist()]
        else:
            parts += words
        count += len(words)
    return count, b" ".join(parts)
