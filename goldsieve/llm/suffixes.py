"""Repeated byte strings across all documents, from range-partitioned suffixes.

Every byte that some ``LENGTH``-byte string covers which also starts elsewhere, in
any document, is removed.  Three passes sort suffixes; each deals them by sampled
splitters over their leading tokens (ties split by place, so a string with a
third of all places spreads over many buckets), sorts each bucket by multikey
quicksort, and compares neighbours, across bucket boundaries too.

Pass one takes one suffix per *anchor*.  Each start p of a string has one: the
place of the least hash of ``GRAM`` bytes inside ``[p, p + LENGTH)``, the leftmost of
equals.  It depends on the string alone, so equal strings have anchors at equal
offsets.  Neighbouring starts share an anchor and form a block.  A block's tokens
are the 8 bytes at the anchor, the anchor's gram, and the bytes that the block's
strings span (the last two as 64-bit hashes).  A neighbour equal in all tokens is
a twin: all the block's strings are repeated.  A neighbour equal up to the gram
only means that some may be.

Pass two opens those blocks, and the twins next to them, and cuts them into cells of
``CELL`` starts at fixed offsets from the anchor.  A cell's tokens are the bytes that
all its strings share, and the bytes they span: again twins settle a cell, and
cells that share only the former go on.  Pass three has one suffix per start of
those cells, with the string's first 8 bytes, its hash and its last 8 bytes as
tokens; a start is repeated if a neighbour is equal.  What shares no tokens with
anyone is not looked at again, and nothing is dropped: equal strings always meet.

Cases: a null text is empty; a text shorter than ``LENGTH`` has no string and keeps
all bytes; overlapping repeats in one text count; equal rows repeat each other;
null keys are kept; texts of any length are read in stretches of ``STRETCH`` starts;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldsieve.durable import written

LENGTH = 400
GRAM = 128
CELL = 16
STRETCH = 1 << 19
# Bytes of short texts that are hashed at once.
PACK = 1 << 16
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(40_320).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Stretch:
    """Prefix sums of a byte array, for hashes of any of its substrings."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Stretch._powers) <= len(data):
            size = max(len(data) + 1, 1 << 16)
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(Stretch, name, np.multiply.accumulate(powers))
        self.data = data
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * Stretch._powers[: len(data)], out=self._sums[1:])

    def hashes(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        """Hashes of the substrings; the same bytes give the same hash anywhere."""
        return _mixed((self._sums[ends] - self._sums[starts]) * Stretch._inverses[starts])

    def tokens(self, places: np.ndarray) -> np.ndarray:
        """The 8 bytes at each place, ordered as the bytes are."""
        found = np.zeros(len(places), np.uint64)
        for offset in range(8):
            found = (found << np.uint64(8)) | self.data[places + offset].astype(np.uint64)
        return found.view(np.int64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window: from minima towards both ends of tiles."""
    count = len(values) - width + 1
    tiles = -(-len(values) // width)
    padded = np.full(tiles * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(tiles, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _anchors(part: Stretch, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and the anchor of each start."""
    grams = part.hashes(slice(0, len(part.data) - gram + 1), slice(gram, None))
    keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    return grams, (window_minima(keyed, length - gram + 1) & _PLACE).astype(np.int64)


def _block_words(part: Stretch, grams: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    shape = _mixed(((at - first) * 1024 + (last - first)).astype(np.uint64))
    whole = part.hashes(first, last + length) ^ shape
    return part.tokens(at), grams[at].view(np.int64), whole.view(np.int64)


def blocks(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """``w0, w1, w2, first, last, anchor`` arrays: the blocks of starts of a text."""
    starts = len(data) - length + 1
    for low in range(0, starts, STRETCH):
        part = Stretch(data[low : min(low + STRETCH, starts) + length - 1])
        grams, anchor = _anchors(part, length, gram)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.append(first[1:], len(anchor)) - 1
        at = anchor[first]
        yield *_block_words(part, grams, at, first, last, length), first + low, last + low, at + low


def bordered(changes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, first, last`` of the runs between ``changes`` in the ascending ranges ``[low, high)``."""
    border = np.append(changes, False)
    border[low] = border[high] = True
    first = np.flatnonzero(border[:-1])
    last = np.append(first[1:], len(changes)) - 1
    text = np.searchsorted(low, first, "right") - 1
    inside = (text >= 0) & (first < high[text])
    return text[inside], first[inside], last[inside]


def packs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of about ``PACK`` bytes: short texts are worked on together."""
    low, size = 0, 0
    for at, more in enumerate(sizes):
        if size and size + more > PACK:
            yield low, at
            low, size = at, 0
        size += more
    if low < len(sizes):
        yield low, len(sizes)


def packed_blocks(texts: list[np.ndarray], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """:func:`blocks` of texts of ``length`` bytes or more, the number of the text first."""
    for one, end in packs([len(text) for text in texts]):
        if end - one == 1:
            for found in blocks(texts[one], length, gram):
                yield np.full(len(found[0]), one), *found
            continue
        sizes = np.array([len(text) for text in texts[one:end]])
        low = np.cumsum(sizes) - sizes
        part = Stretch(np.concatenate(texts[one:end]))
        grams, anchor = _anchors(part, length, gram)
        changes = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        text, first, last = bordered(changes, low, low + sizes - length + 1)
        at, off = anchor[first], low[text]
        yield text + one, *_block_words(part, grams, at, first, last, length), first - off, last - off, at - off


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``counts[n]`` rows of each ``n``: the ``n`` of each row, and its number among them."""
    own = np.repeat(np.arange(len(counts)), counts)
    return own, np.arange(len(own)) - (np.cumsum(counts) - counts)[own]


def cells(
    data: list[bytes], low: np.ndarray, high: np.ndarray, anchor: np.ndarray, length: int = LENGTH, cell: int = CELL
) -> tuple[np.ndarray, ...]:
    """``block, w0, w1, w2, first, last`` of the cells of blocks; their ``data`` start at the bytes ``low``."""
    part = Stretch(np.frombuffer(b"".join(data), np.uint8))
    sizes = np.array([len(one) for one in data])
    least = (anchor - high) // cell
    own, number = _spread((anchor - low) // cell + 1 - least)
    number += least[own]
    ends = (anchor - low)[own] - number * cell  # the last start of each whole cell
    first, last = np.maximum(ends - cell + 1, 0), np.minimum(ends, (high - low)[own])
    off = (np.cumsum(sizes) - sizes)[own]
    # What all strings of the whole cell share; those of a clipped cell have it too.
    core_from, core_to = ends + off, ends - cell + 1 + length + off
    shared = part.hashes(core_from, core_to) ^ _mixed(number.astype(np.uint64))
    shape = _mixed(((ends - first) * 1024 + (ends - last)).astype(np.uint64))
    whole = part.hashes(first + off, last + length + off) ^ shape
    lead = part.tokens(core_from)
    return own, lead, shared.view(np.int64), whole.view(np.int64), first + low[own], last + low[own]


def strings(
    data: list[bytes], low: np.ndarray, block: np.ndarray, first: np.ndarray, last: np.ndarray, length: int = LENGTH
) -> tuple[np.ndarray, ...]:
    """``block, w0, w1, w2, start`` of the starts ``first`` to ``last`` of blocks, given by their number."""
    part = Stretch(np.frombuffer(b"".join(data), np.uint8))
    sizes = np.array([len(one) for one in data])
    off = np.cumsum(sizes) - sizes - low
    own, start = _spread(last - first + 1)
    start, own = start + first[own], block[own]
    place = start + off[own]
    whole = part.hashes(place, place + length).view(np.int64)
    return own, part.tokens(place), whole, part.tokens(place + length - 8), start


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their words: three-way partition on a word, equals on the next."""
    order = np.arange(len(words[0]))
    open_ = [(0, len(order), 0)]
    while open_:
        low, high, depth = open_.pop()
        part = order[low:high]
        if high - low < 2 or depth == len(words):
            continue
        if high - low <= 4096:
            order[low:high] = part[np.lexsort([word[part] for word in reversed(words[depth:])])]
            continue
        column = words[depth][part]
        pivot = np.sort(column[:: len(column) // 63])[31]
        less, same = column < pivot, column == pivot
        order[low:high] = np.concatenate((part[less], part[same], part[~(less | same)]))
        first, second = low + int(less.sum()), low + int(less.sum() + same.sum())
        open_ += [(low, first, depth), (first, second, depth + 1), (second, high, depth)]
    return order


UNITS = "w0 bigint, w1 bigint, w2 bigint, doc bigint, row bigint, first int, last int, anchor int"
_UNIT_NAMES = [part.split()[0] for part in UNITS.split(", ")]
_UNIT_TYPES = [pa.int64()] * 5 + [pa.int32()] * 3
# Units that a bucket, held in memory by one task, is planned for.
BUCKET_UNITS = 2_000_000
_EDGES = "bucket int, edge int, before int, after int"
FIRST, LAST = 1, 2


def _units(columns: list, names: list[str] = _UNIT_NAMES, types: list = _UNIT_TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column).cast(kind) for column, kind in zip(columns, types)], names
    )


def neighbours(units: DataFrame) -> DataFrame:
    """The units with a neighbour that agrees in two or three words.

    ``twin``: some neighbour agrees in all three.  ``kin``: some neighbour agrees in
    the first two only.  Units are compared in global order; a bucket's first and
    last unit meet the buckets next to it, of which one row each is compared in
    one task.
    """
    names, types = _UNIT_NAMES + ["bucket", "edge", "before", "after"], _UNIT_TYPES + [pa.int32()] * 4

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId()
        held = [[column.to_numpy(zero_copy_only=False) for column in batch.columns] for batch in batches]
        if not sum(len(columns[0]) for columns in held):
            return
        columns = [np.concatenate(parts) for parts in zip(*held)]
        held.clear()
        order = multikey_order(columns[:3])
        columns = [column[order] for column in columns]
        common, still = np.zeros(len(order) + 1, np.int32), np.ones(max(0, len(order) - 1), bool)
        for word in columns[:3]:
            still = still & (word[1:] == word[:-1])
            common[1:-1] += still
        edge = np.zeros(len(order), np.int32)
        edge[0] += FIRST
        edge[-1] += LAST
        before, after = common[:-1], common[1:]
        keep = np.flatnonzero((before >= 2) | (after >= 2) | (edge > 0))
        for at in range(0, len(keep), 50_000):
            some = keep[at : at + 50_000]
            more = [np.full(len(some), bucket, np.int32), edge[some], before[some], after[some]]
            yield _units([column[some] for column in columns] + more, names, types)

    buckets = units.count() // BUCKET_UNITS + 1
    planned = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more_than_planned = [buckets] if buckets > planned else []
    dealt = units.select(*_UNIT_NAMES).repartitionByRange(*more_than_planned, "w0", "w1", "w2", "doc", "first")
    found = written(dealt.mapInArrow(sort, f"{UNITS}, {_EDGES}"), "suffixes")
    words = ["w0", "w1", "w2"]
    in_order = Window.orderBy("bucket")

    def agreed(one: str, two: str) -> Column:
        same = [F.coalesce(F.col(f"{one}.{word}") == F.col(f"{two}.{word}"), F.lit(False)) for word in words]
        deep = F.when(same[1], F.when(same[2], 3).otherwise(2)).otherwise(1)
        return F.when(same[0], deep).otherwise(0)

    ends = (
        found.where("edge > 0")
        .groupBy("bucket")
        .agg(
            F.max(F.when(F.col("edge").bitwiseAND(FIRST) > 0, F.struct(*words))).alias("head"),
            F.max(F.when(F.col("edge").bitwiseAND(LAST) > 0, F.struct(*words))).alias("tail"),
        )
        .select(
            "bucket", "head", "tail",
            F.lag("tail").over(in_order).alias("earlier"),
            F.lead("head").over(in_order).alias("later"),
        )
        .select("bucket", agreed("head", "earlier").alias("at_head"), agreed("tail", "later").alias("at_tail"))
    )
    before = F.when(F.col("edge").bitwiseAND(FIRST) > 0, F.col("at_head")).otherwise(F.col("before"))
    after = F.when(F.col("edge").bitwiseAND(LAST) > 0, F.col("at_tail")).otherwise(F.col("after"))
    return (
        found.join(F.broadcast(ends), "bucket")
        .select(*_UNIT_NAMES, before.alias("before"), after.alias("after"))
        .select(
            "doc", "row", "first", "last", "anchor",
            ((F.col("before") == 3) | (F.col("after") == 3)).alias("twin"),
            ((F.col("before") == 2) | (F.col("after") == 2)).alias("kin"),
        )
        .where("twin OR kin")
    )


def _named(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``doc, row``: the key, and a 64-bit hash of the text.

    Equal rows have equal names: what is repeated in one is repeated in the other.
    """
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"),
    )


def _bytes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.empty(0, np.uint8)


def _all_blocks(named: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = (batch.column(at).to_numpy() for at in (0, 1))
            held, size = [], 0
            for text, *found in packed_blocks([_bytes(text) for text in batch.column(2)], length, gram):
                held.append([*found[:3], docs[text], rows[text], *found[3:]])
                size += len(text)
                if size > 100_000:
                    yield _units([np.concatenate(column) for column in zip(*held)])
                    held, size = [], 0
            if held:
                yield _units([np.concatenate(column) for column in zip(*held)])

    return named.where(F.octet_length("text") >= length).select("doc", "row", "text").mapInArrow(run, UNITS)


def _block_bytes(named: DataFrame, probes: DataFrame, length: int) -> DataFrame:
    """``doc, row, first, last, anchor, data``: the bytes that the blocks' strings span."""
    lists = probes.groupBy("doc", "row").agg(
        F.collect_set(F.struct("first", "last", "anchor")).alias("blocks")
    )
    texts = named.select("doc", "row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "row", "first", "last", "anchor", "data"]
        types = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.binary()]
        for batch in batches:
            for doc, row, text, wanted in zip(*batch.columns):
                data = _bytes(text)
                rows = [
                    (doc.as_py(), row.as_py(), b["first"], b["last"], b["anchor"],
                     data[b["first"] : b["last"] + length].tobytes())
                    for b in wanted.as_py()
                ]
                for at in range(0, len(rows), 20_000):
                    columns = zip(*rows[at : at + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return texts.join(lists, ["doc", "row"]).mapInArrow(
        run, "doc bigint, row bigint, first int, last int, anchor int, data binary"
    )


def _cells_of(held: DataFrame, length: int) -> DataFrame:
    """Cells of each block; ``anchor`` is the block's first start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row, low, high, anchor = (batch.column(at).to_numpy().astype(np.int64) for at in range(5))
            data = batch.column(5).to_pylist()
            for one, end in packs([len(part) for part in data]):
                own, *found = cells(data[one:end], low[one:end], high[one:end], anchor[one:end], length)
                own += one
                yield _units([*found[:3], doc[own], row[own], *found[3:], low[own]])

    return held.select("doc", "row", "first", "last", "anchor", "data").mapInArrow(run, UNITS)


def _strings_of(held: DataFrame, probes: DataFrame, length: int) -> DataFrame:
    """One unit per start of the cells ``probes``, from their blocks' bytes."""
    lists = probes.groupBy("doc", "row", F.col("anchor").alias("block")).agg(
        F.collect_set(F.struct("first", "last")).alias("cells")
    )
    blocks_ = held.select("doc", "row", F.col("first").alias("block"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row, low = (batch.column(at).to_numpy().astype(np.int64) for at in range(3))
            data, wanted = batch.column(3).to_pylist(), batch.column(4)
            for one, end in packs([len(part) for part in data]):
                lists = wanted.slice(one, end - one)
                block = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                first, last = (lists.flatten().field(at).to_numpy().astype(np.int64) for at in (0, 1))
                own, *words, start = strings(data[one:end], low[one:end], block, first, last, length)
                own += one
                yield _units([*words, doc[own], row[own], start, start, low[own]])

    joined = blocks_.join(lists, ["doc", "row", "block"])
    return joined.select("doc", "row", "block", "data", "cells").mapInArrow(run, UNITS)


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc, row, first, last``: ranges of starts of strings that also start elsewhere."""
    named = _named(docs)
    first = written(neighbours(written(_all_blocks(named, length, gram), "blocks")), "blocks")
    held = written(_block_bytes(named, first.where("kin"), length), "bytes")
    # A block that is listed twice stands in two equal rows: each is an occurrence.
    second = written(neighbours(written(_cells_of(held, length), "cells")), "cells")
    third = neighbours(written(_strings_of(held, second.where("kin"), length), "strings"))
    found = [part.where("twin").select("doc", "row", "first", "last") for part in (first, second, third)]
    return written(found[0].unionByName(found[1]).unionByName(found[2]).distinct(), "starts")


RESULT = (
    "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, "
    "shares_run boolean"
)


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the covered bytes."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    opens = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[opens], ends[np.append(np.flatnonzero(opens)[1:] - 1, len(ends) - 1)]


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, runs: DataFrame | None = None
) -> DataFrame:
    """``doc_id``, counts, ``kept_sha256`` and the ``kept`` bytes of every row of ``docs``.

    ``shares_run``: the row is named in ``runs(doc, row)``, the documents with a run of
    words that another has; null without it.
    """
    spans = repeated_starts(docs, length, gram).groupBy("doc", "row").agg(
        F.collect_list(F.struct("first", "last")).alias("starts")
    )
    names = [part.split()[0] for part in RESULT.split(", ")]
    types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.bool_()]
    named = _named(docs)
    if runs is None:
        spans = spans.withColumn("shared", F.lit(None).cast("boolean"))
        named = named.withColumn("told", F.lit(None).cast("boolean"))
    else:
        spans = spans.join(runs.select("doc", "row", F.lit(True).alias("shared")), ["doc", "row"], "full")
        named = named.withColumn("told", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, found, shared in zip(*batch.columns):
                data, kept, low, high = _bytes(text), b"", np.empty(0), np.empty(0)
                if found.is_valid:
                    pairs = found.values
                    starts = pairs.field(0).to_numpy().astype(np.int64)
                    ends = pairs.field(1).to_numpy().astype(np.int64) + length
                    low, high = merged_spans(starts, ends)
                    edges = [0, *np.stack((low, high), 1).ravel().tolist(), len(data)]
                    kept = b"".join(data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2]))
                else:
                    kept = data.tobytes()
                digest = hashlib.sha256(kept).hexdigest()
                out.append((key.as_py(), len(data), len(data) - len(kept), len(low), digest, kept, shared.as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    joined = named.join(spans, ["doc", "row"], "left")
    shared = F.coalesce("shared", "told").alias("shared")
    return joined.select("doc_id", "text", "starts", shared).mapInArrow(run, RESULT)
