"""Near-duplicate documents: banded MinHash, sequential Bayesian verification.

A document's set is its distinct two-word shingles.  Documents with equal sets are
one class, so copies meet nobody.  A class's signature has ``BANDS`` bands of
``ROWS`` minima; a link at similarity 0.8 escapes all bands with a chance of about
5 in a million.  Classes that share a band are candidates.  A candidate pair's
signatures are compared a batch at a time: with m of n minima equal, the
similarity has the posterior Beta(m + 1, n - m + 1), and a pair is dropped as soon
as it reaches ``PERCENT`` with a chance below ``MISS``.  Survivors are confirmed on
their full sets.  Minima are kept to 8 bits: a chance agreement only makes the
test more careful.

Nobody writes out the pairs of a band's bucket:

1. Buckets with the same members are one bucket, told by a 128-bit hash of them: a
   group of near copies shares most of its bands.  The first band stays.
2. Members meet their bucket's least member, by signature, then exactly, and links are
   joined into components.  A group of near copies is mostly one component after that.
3. Buckets that still span components are compared inside tasks, pairs of one
   component left out, each pair in the first band that it shares: by signature,
   to see who takes part, then those exactly, with their sets.

Buckets beyond ``BLOCK_BYTES`` or ``BLOCK_MEMBERS`` are cut into blocks, and each two
blocks are a group of their own, so no task holds more, and no pair is left out.
Components spread by least label and pointer jumps over written tables; neither links
nor sets reach the driver.

Cases: a null or empty text, or one without words, has an empty set and is linked
with nothing; one word makes a set of one; equal rows are one class; rows that
share a key are one vertex, linked by any of their texts, and the classes of its texts
are joined through it; a row without a key is compared with nothing and kept; an empty
table gives an empty result; other columns are not read, and pass through
:func:`drop_near_duplicates` whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.durable import written
from goldsieve.llm.scratch import Scratch
from goldsieve.llm.shuffles import bounded_batches, release_shuffles

BANDS, ROWS = 40, 6
BATCH = 48
PERCENT = 80
MISS = 1e-6
SHINGLE_WORDS = 2
BLOCK_BYTES = 16 << 20
BLOCK_MEMBERS = 256

_rng = np.random.default_rng(20_240)
_FLIP = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND_TIMES = _rng.integers(0, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def shingles(text: str, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    count = len(words) - width + 1
    found = np.full(count, width, np.uint64)
    for place in range(width):
        found = _mixed(found * np.uint64(3) + hashes[place : place + count])
    return np.unique(found)


def signature(found: np.ndarray) -> np.ndarray:
    """``BANDS * ROWS`` minima of a non-empty set, in stretches that fit the cache."""
    values = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), 256):
        turned = values[at : at + 256, None] ^ _FLIP
        turned *= _TIMES
        np.minimum(best, turned.min(0), out=best)
    return best


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One key per band; the band's number is part of it."""
    keys = _mixed(minima.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _BAND_TIMES
    return _mixed(keys.sum(1)).view(np.int64)


def short_minima(minima: np.ndarray) -> np.ndarray:
    """8 bits of each minimum, mixed: the high bits of a minimum are mostly zero."""
    return (_mixed(minima.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


def least_matches(n: int, miss: float = MISS, percent: int = PERCENT) -> int:
    """Fewest equal minima of n with P(similarity >= percent) at least ``miss``.

    The tail of Beta(m + 1, n - m + 1) above t is the chance of at most m
    successes in n + 1 trials of chance t.
    """
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n + 1


_NEEDED = [(n, least_matches(n)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]


def could_be_similar(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which rows of ``many`` survive the sequential test against ``one``.

    Batch after batch of minima is compared; a row leaves once its posterior
    gets too low.
    """
    left = np.arange(len(many))
    equal = np.zeros(len(many), np.int64)
    for n, needed in _NEEDED:
        equal += (many[left, n - BATCH : n] == one[n - BATCH : n]).sum(1)
        stay = equal >= needed
        left, equal = left[stay], equal[stay]
    return left


def similar(one: np.ndarray, two: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact test on two sorted sets."""
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    both = np.concatenate((one, two))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(one) + len(two) - shared)


def _classes_of(docs: DataFrame, width: int) -> DataFrame:
    """Key, set size, class, band keys and minima of each row; an empty set has no class."""
    names = ["doc_id", "n_shingles", "class", "bands", "minima"]
    bands_type = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, classes, bands, minima = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py() or "", width)
                counts.append(len(found))
                some = len(found) > 0
                classes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if some else None)
                least = signature(found) if some else None
                bands.append(band_keys(least) if some else None)
                minima.append(short_minima(least).tobytes() if some else None)
            columns = [
                batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()),
                pa.array(classes, pa.binary()), pa.array(bands, bands_type),
                pa.array(minima, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, class binary, bands array<bigint>, minima binary"
    )


def _records_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, found`` of the documents that are candidates; equal rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1)):
                found = shingles(text.as_py() or "", width)
                if len(found):
                    columns = [pa.array([node.as_py()], pa.int64()), pa.array([found.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "found"])

    wanted = docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").join(nodes, "node")
    return wanted.select("node", "text").mapInArrow(run, "node bigint, found binary")


def _met(pairs: DataFrame, rows: DataFrame, column: str, agree) -> DataFrame:
    """The pairs ``a, b`` whose values of a binary column of ``rows(node, ..)`` agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [agree(one.as_buffer(), two.as_buffer()) for one, two in zip(*batch.columns[2:])]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def side(name: str) -> DataFrame:
        return rows.select(F.col("node").alias(name), F.col(column).alias(f"of_{name}"))

    met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "of_a", "of_b")
    return met.mapInArrow(run, "a bigint, b bigint")


def _signatures_agree(one: pa.Buffer, two: pa.Buffer) -> bool:
    return len(could_be_similar(np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)[None])) > 0


def _sets_agree(one: pa.Buffer, two: pa.Buffer) -> bool:
    return similar(np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64))


class Group:
    """Members of one group, as arrays in one order, and what to compare."""

    def __init__(self, rows: list[tuple]):
        key = rows[0][:3]
        self.key = key[0]
        self.two_blocks = key[1] != key[2]
        self.part = np.array([row[3] for row in rows])
        self.low = key[1]
        self.node = np.array([row[4] for row in rows])
        self.label = np.array([row[5] for row in rows])
        self.size = np.array([row[6] for row in rows])
        self.band = rows[0][7]
        self.bands = np.array([row[8] for row in rows], np.int64)
        self.minima = np.stack([np.frombuffer(row[9], np.uint8) for row in rows])
        self.found = [np.frombuffer(row[10], np.uint64) if row[10] is not None else None for row in rows]

    def partners(self, at: int) -> np.ndarray:
        """Later members that ``at`` is compared with, as far as sizes and bands tell."""
        if self.two_blocks:
            if self.part[at] != self.low:
                return np.empty(0, np.int64)
            others = np.flatnonzero(self.part != self.low)
        else:
            others = np.arange(at + 1, len(self.node))
        one, sizes = self.size[at], self.size[others]
        fits = (100 * np.minimum(one, sizes) >= PERCENT * np.maximum(one, sizes)) & (
            self.node[others] != self.node[at]
        )
        others = others[fits]
        if self.band and len(others):
            # A pair that shares an earlier band is compared there.
            met = (self.bands[others, : self.band] == self.bands[at, : self.band]).any(1)
            others = others[~met]
        return others


def links_across(group: Group) -> list[tuple[int, int]]:
    """Links that join the group's components; one component is not compared within."""
    found = []
    for at in range(len(group.node)):
        others = group.partners(at)
        others = others[group.label[others] != group.label[at]]
        if not len(others):
            continue
        for other in others[could_be_similar(group.minima[at], group.minima[others])]:
            if group.label[other] != group.label[at] and similar(group.found[at], group.found[other]):
                found.append(tuple(sorted((int(group.node[at]), int(group.node[other])))))
                group.label[group.label == group.label[other]] = group.label[at]
    return found


def across(group: Group) -> list[tuple[int, int]]:
    """``key, node`` of the members with a plausible partner in another component."""
    known = np.zeros(len(group.node), bool)
    for at in range(len(group.node)):
        others = group.partners(at)
        others = others[group.label[others] != group.label[at]]
        # Both of a pair take part; two that take part already need no look.
        if known[at]:
            others = others[~known[others]]
        if len(others):
            left = others[could_be_similar(group.minima[at], group.minima[others])]
            known[left] = True
            known[at] |= len(left) > 0
    return [(group.key, node) for node in group.node[known].tolist()]


def _grouped(members: DataFrame, sizes: DataFrame, each, schema: str) -> DataFrame:
    """``each(group)`` for the groups of every bucket of ``members``.

    ``sizes(key, bytes, members)`` says how many blocks a bucket needs.  A member goes
    once to each pair of its own block and another.
    """
    parts = F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("members") / BLOCK_MEMBERS), F.lit(1))
    parts = parts.cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = (
        members.join(sizes.select("key", parts.alias("parts")), "key")
        .withColumn("part", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
            "part", "node", "label", "n", "band", "bands", "minima", "found",
        )
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high", "node")
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = each(Group(held)) if len(held) > 1 else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    yield from flush()
                    held = []
                held.append(row)
        if held:
            yield from flush()

    return dealt.mapInArrow(run, schema)


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label``: the least node that is reachable, from labels so far.

    Each turn takes the least label of a node and its neighbours and follows the
    label's own label once, until no label changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both, "links")
    labels = written(labels, "labels")
    while True:
        offers = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(
            F.col("a").alias("node"), "label"
        )
        nearest = written(
            labels.withColumn("old", F.col("label"))
            .unionByName(offers.withColumn("old", F.lit(None).cast("bigint")))
            .groupBy("node")
            .agg(F.min("label").alias("label"), F.min("old").alias("old")),
            "labels",
        )
        target = nearest.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = written(
            nearest.join(target, "label", "left").select(
                "node", F.least("label", F.coalesce("next", "label")).alias("label"), "old"
            ),
            "labels",
        )
        moved = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not moved:
            return labels


def _buckets(classes: DataFrame) -> DataFrame:
    """``key, node, band`` of the buckets with several members, one of those with the same."""
    listed = classes.select("node", F.posexplode("bands").alias("band", "key"))
    # Most keys have one member: they are counted without anything else, and gone.
    several = listed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    several = written(several.select("key"), "shared")
    release_shuffles(classes.sparkSession)
    met = written(listed.join(several, "key"), "met")
    kept = (
        met.groupBy("key")
        .agg(
            F.first("band").alias("band"),
            F.count(F.lit(1)).alias("members"),
            F.bit_xor(F.xxhash64("node")).alias("one"),
            F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("two"),
        )
        .groupBy("members", "one", "two")
        .agg(F.min(F.struct("band", "key")).alias("kept"))
        .select("kept.key")
    )
    return met.join(written(kept, "kept"), "key")


def _same_key(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``a, b`` between a key with several texts and the nodes of their classes."""
    several = keyed.groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    several = several.where("low <> high").select("doc_id")
    links = keyed.join(several, "doc_id").select("class", F.col("doc_id").alias("b")).join(classes, "class")
    return written(links.select(F.col("node").alias("a"), "b").where("a <> b").distinct(), "same-key")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch("near-duplicates")
    wide = scratch.write(_classes_of(docs, width), "classes")
    rows = written(wide.select("doc_id", "n_shingles", "class"), "classes")
    keyed = rows.where("class IS NOT NULL AND doc_id IS NOT NULL")
    one = F.min_by(F.struct("bands", "minima", "n_shingles"), "doc_id")
    classes = written(
        wide.where("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("node"), one.alias("one")).select("class", "node", "one.*"),
        "nodes",
    )
    scratch.drop(wide)
    signed = classes.select("node", F.col("n_shingles").alias("n"), "bands", "minima")
    members = written(_buckets(classes), "members")
    release_shuffles(docs.sparkSession)
    leaders = written(members.groupBy("key").agg(F.min("node").alias("a")), "leaders")
    pairs = members.select("key", F.col("node").alias("b")).join(leaders, "key").where("a <> b")
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    pairs = written(_met(pairs, signed, "minima", _signatures_agree).distinct(), "pairs")
    release_shuffles(docs.sparkSession)
    taking = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    records = written(_records_of(docs, written(taking, "taking"), width), "records")
    links = written(_met(pairs, records, "found", _sets_agree).distinct(), "links")
    release_shuffles(docs.sparkSession)
    same_key = _same_key(keyed, classes)
    nodes = members.select("node").unionByName(same_key.select(F.col("a").alias("node"))).unionByName(
        same_key.select(F.col("b").alias("node"))
    )
    labels = components(
        nodes.distinct().select("node", F.col("node").alias("label")), links.unionByName(same_key)
    )
    labelled = written(members.join(labels, "node"), "members")
    sizes = classes.groupBy("node").agg(F.max("n_shingles").alias("n"))
    spanning = written(
        labelled.join(sizes, "node")
        .groupBy("key")
        .agg(
            F.min("label").alias("low"),
            F.max("label").alias("high"),
            F.sum(8 * F.col("n") + 1000).alias("bytes"),
            F.count(F.lit(1)).alias("members"),
        )
        .where("low <> high")
        .select("key", "bytes", "members"),
        "spanning",
    )
    release_shuffles(docs.sparkSession)
    apart = written(labelled.join(spanning.select("key"), "key"), "apart")
    nothing = F.lit(None).cast("binary").alias("found")
    # Signatures alone need less room than sets: larger blocks for them.
    light = spanning.select("key", F.lit(0).alias("bytes"), "members")
    taking = written(
        _grouped(apart.join(signed, "node").select("*", nothing), light, across, "key bigint, node bigint")
        .distinct(),
        "taking",
    )
    release_shuffles(docs.sparkSession)
    records = written(_records_of(docs, taking.select("node").distinct(), width), "records")
    apart = apart.join(taking, ["key", "node"]).join(signed, "node").join(records, "node")
    joined = written(_grouped(apart, spanning, links_across, "a bigint, b bigint").distinct(), "links")
    release_shuffles(docs.sparkSession)
    labels = components(labels, joined)
    named = written(
        classes.select("class", "node").join(labels, "node", "left").select(
            "class", F.coalesce("label", "node").alias("label")
        ),
        "named",
    )
    release_shuffles(docs.sparkSession)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return rows.join(named, "class", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one document of each component: the one with the least key.

    Of several rows with that key one stays, that whose text has the least hash; rows
    without a key all stay.
    """
    key = f"key_{uuid.uuid4().hex}"
    gone = near_duplicates(docs, width).where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    left = docs.join(written(gone, "copies"), F.col("doc_id") == F.col(key), "left_anti")
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias(key)).where(f"{key} > 1 AND doc_id IS NOT NULL")
    again = written(again.select(F.col("doc_id").alias(key)), "repeated")
    if not again.limit(1).count():
        return left
    met = F.col("doc_id") == F.col(key)
    one = left.join(again, met, "left_semi").groupBy(F.col("doc_id").alias(key)).agg(
        F.min_by(F.struct(*(F.col(f"`{name}`") for name in docs.columns)), F.xxhash64("text")).alias("row")
    )
    return left.join(again, met, "left_anti").unionByName(one.select("row.*"))
