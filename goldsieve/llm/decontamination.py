"""Benchmark passages in documents, found by spaced seeds; DataFrame functions only.

A text is a sequence of words: runs of ASCII letters and digits and of other
characters beyond ASCII, in lower case.  A mask fixes which of a few neighbouring
words are hashed; the words between are free, so a substituted word does not
hide a passage.  Seeds of documents and benchmark items are joined; each hit
says on which diagonal (document place minus item place) to look, and there the
words are compared.  An item is found if some ``WINDOW`` words of it in a row (all,
if it has fewer) agree with the document in at least ``MIN_PERCENT`` percent.

The masks leave no gap: any window of ``MIN_WORDS`` to ``WINDOW`` words with at most a
fifth substituted holds an undisturbed seed (tried for every choice of places), so
joins miss nothing within the bound.
Item seeds are sent to the tasks when ``BROADCAST_SEEDS`` or fewer, which is counted;
otherwise the sides are shuffled by seed.  Each document's words are hashed
once where they are read; only hits and texts with hits move.

Items under ``MIN_WORDS`` words hold no seed that survives a change; they are found
where they stand word for word, by a join of whole items with the documents' runs of
as many words.

Cases: a null or empty text has no words; an item without words is never found; null
items are ignored; equal items count one by one; documents that share a key share a
verdict, null keys included; an empty table of items finds nothing; extra columns are
not read, and pass through :func:`drop_contaminated` whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldsieve.durable import written

MASKS = ((0, 4, 5, 6, 7), (0, 1, 3, 4, 8), (0, 1, 3, 5, 6))
MIN_WORDS = 9
WINDOW = 20
MIN_PERCENT = 80
BROADCAST_SEEDS = 2_000_000
_GAPS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAPS), "")


def seeds(texts: DataFrame, *keys: str) -> DataFrame:
    """``keys, seed, place`` of every mask at every place of ``texts(keys, text)``."""
    hashed = texts.select(*keys, F.transform(words(F.col("text")), lambda word: F.xxhash64(word)).alias("hashes"))
    count, masks = F.size("hashes"), len(MASKS)

    def seed(number: Column) -> Column:
        place, found = (number / masks).cast("int"), F.lit(None).cast("bigint")
        for which, mask in enumerate(MASKS):
            picked = [F.get("hashes", place + offset) for offset in mask]
            whole = (number % masks == which) & picked[-1].isNotNull()
            found = F.when(whole, F.xxhash64(F.lit(which), *picked)).otherwise(found)
        return found

    shortest = min(mask[-1] for mask in MASKS)
    numbers = F.sequence(F.lit(0), masks * (count - shortest) - 1)
    listed = F.when(count > shortest, F.transform(numbers, seed)).otherwise(F.array().cast("array<bigint>"))
    return (
        hashed.select(*keys, F.posexplode(listed).alias("number", "seed"))
        .where("seed IS NOT NULL")
        .select(*keys, "seed", (F.col("number") / masks).cast("int").alias("place"))
    )


def short_items(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """``doc_id, item_id, overlap`` of items under ``MIN_WORDS`` words; ``None`` without such items.

    A run of words is compared as one string: no word holds a blank.
    """
    listed = items.select("item_id", words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    listed = listed.where(f"n > 0 AND n < {MIN_WORDS}")
    sizes = [row["n"] for row in listed.select("n").distinct().collect()]  # MIN_WORDS - 1 at most
    if not sizes:
        return None
    found = docs.select("doc_id", words(F.col("text")).alias("words"))
    count, none = F.size("words"), F.array().cast("array<string>")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), count - n + 1)
        joined = F.transform(starts, lambda at: F.concat_ws(" ", F.slice("words", at, F.lit(n))))
        return F.when(count >= n, F.array_distinct(joined)).otherwise(none)

    whole = listed.select("item_id", F.concat_ws(" ", "words").alias("run"))
    few = whole.count() <= BROADCAST_SEEDS
    return (
        found.select("doc_id", F.explode(F.concat(*map(runs, sizes))).alias("run"))
        .join(F.broadcast(whole) if few else whole, "run")
        .select("doc_id", "item_id", F.lit(1.0).alias("overlap"))
        .distinct()
    )


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, overlap``: items found, with the best window's share."""
    found, short = long_items(docs, items), short_items(docs, items)
    return found if short is None else found.unionByName(short)


def long_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, overlap`` of items with ``MIN_WORDS`` words or more."""
    wanted = items.where(F.size(words(F.col("text"))) >= MIN_WORDS).select(F.col("item_id"), "text")
    item_seeds = written(
        seeds(wanted, "item_id").select("item_id", "seed", F.col("place").alias("item_place")), "seeds"
    )
    few = item_seeds.count() <= BROADCAST_SEEDS
    doc_seeds = seeds(docs.select("doc_id", "text"), "doc_id")
    hits = written(
        doc_seeds.join(F.broadcast(item_seeds) if few else item_seeds, "seed")
        .select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal"))
        .distinct(),
        "hits",
    )
    lengths = wanted.select("item_id", words(F.col("text")).alias("item_words"))
    sizes = lengths.select("item_id", F.size("item_words").alias("n"))
    by_doc = hits.join(sizes, "item_id").groupBy("doc_id").agg(
        F.collect_list(F.struct("item_id", "diagonal", "n")).alias("hits")
    ).withColumnRenamed("doc_id", "hit_doc")
    texts = (
        docs.select("doc_id", "text")
        .join(by_doc, F.col("doc_id").eqNullSafe(F.col("hit_doc")))
        .select("doc_id", words(F.col("text")).alias("words"), "hits")
    )
    longest = lengths.agg(F.max(F.size("item_words"))).first()[0] or 0
    # A diagonal's piece is as long as its item.
    pieces = texts.select("doc_id", "words", F.explode("hits").alias("hit")).select(
        "doc_id",
        "hit.item_id",
        F.greatest(-F.col("hit.diagonal"), F.lit(0)).alias("skipped"),
        F.slice("words", F.greatest(F.col("hit.diagonal"), F.lit(0)) + 1, F.col("hit.n")).alias("piece"),
    )
    small = lengths.count() * max(1, longest) <= BROADCAST_SEEDS
    meeting = pieces.join(F.broadcast(lengths) if small else lengths, "item_id")
    length = F.size("item_words")
    same = F.transform(
        "item_words",
        lambda word, at: F.coalesce(
            (at >= F.col("skipped")) & (F.get("piece", at - F.col("skipped")) == word), F.lit(False)
        ).cast("int"),
    )
    window = F.least(F.lit(WINDOW), length)
    compared = meeting.select("doc_id", "item_id", same.alias("same"), window.alias("size"), length.alias("n"))
    agreeing = F.transform(
        F.sequence(F.lit(1), F.col("n") - F.col("size") + 1),
        lambda start: F.aggregate(
            F.slice("same", start, F.col("size")), F.lit(0), lambda total, one: total + one
        ),
    )
    return (
        compared.select("doc_id", "item_id", "size", F.array_max(agreeing).alias("best"))
        .where(F.col("best") * 100 >= F.col("size") * MIN_PERCENT)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.col("best") / F.col("size")).alias("overlap"))
    )


def decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each row's verdict: ``doc_id, contaminated, n_items, first_item, overlap``."""
    found = (
        overlaps(docs, items)
        .groupBy(F.col("doc_id").alias("found_doc"))
        .agg(
            F.count(F.lit(1)).alias("n_items"),
            F.min("item_id").alias("first_item"),
            F.max("overlap").alias("overlap"),
        )
    )
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("found_doc")), "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "first_item",
        F.coalesce("overlap", F.lit(0.0)).alias("overlap"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage."""
    key = f"key_{uuid.uuid4().hex}"
    bad = written(overlaps(docs, items).select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(key)), "left_anti")
