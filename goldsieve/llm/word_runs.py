"""Runs of words that documents share, by the suffix passes over word tokens.

The same passes as over bytes (:mod:`goldsieve.llm.suffixes`), with words as the tokens and
``RUN_WORDS`` of them as the string.  Neighbouring starts with the same anchor, the least of
the grams of ``GRAM_WORDS`` words in their run, are a block.  Blocks are sorted across
buckets by their gram and all their words: equal neighbours share every run, and blocks
that share the gram only are opened, each start a suffix of its own, sorted by the two
halves of its run.

A document sends each distinct block and run once, so what it repeats in itself finds no
partner: only another document (or another row with the same text) makes a run shared.

Cases: as in :mod:`goldsieve.llm.suffixes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.durable import written
from goldsieve.llm.passages import _PLACE, Runs, _text, blocks, word_hashes, word_spans
from goldsieve.llm.suffixes import (
    UNITS,
    Stretch,
    _mixed,
    _named,
    _spread,
    _units,
    bordered,
    neighbours,
    packs,
    window_minima,
)

RUN_WORDS = 50
GRAM_WORDS = 16


def _words_of(texts: list[memoryview | bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the place of each text's first one, the end last."""
    if len(texts) == 1:
        words = word_hashes(texts[0])
        return words, np.array([0, len(words)])
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = word_spans(data)
    words = Stretch(data).hashes(starts, ends) if len(starts) else np.empty(0, np.uint64)
    sizes = np.array([len(text) + 1 for text in texts])
    return words, np.searchsorted(starts, np.append(0, np.cumsum(sizes)))


def packed_blocks(texts: list[memoryview | bytes], gram: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``text, g, s, first, last``: the blocks of many texts, as :func:`goldsieve.llm.passages.blocks` has them."""
    for one, end in packs([len(text) for text in texts]):
        words, low = _words_of(texts[one:end])
        if end - one == 1:
            for found in blocks(words, gram, size):
                yield np.full(len(found[0]), one), *found
            continue
        long = np.flatnonzero(np.diff(low) >= size)
        if not len(long):
            continue
        runs = Runs(words)
        grams = runs.hashes(slice(0, len(words) - gram + 1), slice(gram, None))
        keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        anchor = (window_minima(keyed, size - gram + 1) & _PLACE).astype(np.int64)
        changes = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        text, first, last = bordered(changes, low[long], low[long + 1] - size + 1)
        segment = runs.hashes(first, last + size) ^ _mixed((last - first).astype(np.uint64))
        off = low[long][text]
        yield long[text] + one, grams[anchor[first]].view(np.int64), segment.view(np.int64), first - off, last - off


def _once(*keys: np.ndarray) -> np.ndarray:
    """Places of the first of the rows that agree in all keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    return order[new]


def _block_units(named: DataFrame, size: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = (batch.column(at).to_numpy() for at in (0, 1))
            held, count = [], 0
            for text, g, s, first, last in packed_blocks([_text(text) for text in batch.column(2)], gram, size):
                once = _once(s, text)
                n, own = len(once), text[once]
                held.append(
                    [g[once], np.zeros(n, np.int64), s[once], docs[own], rows[own], first[once], last[once], first[once]]
                )
                count += n
                if count > 100_000:
                    yield _units([np.concatenate(column) for column in zip(*held)])
                    held, count = [], 0
            if held:
                yield _units([np.concatenate(column) for column in zip(*held)])

    return named.where(F.octet_length("text") >= 2 * size - 1).select("doc", "row", "text").mapInArrow(run, UNITS)


def _run_units(named: DataFrame, probes: DataFrame, size: int) -> DataFrame:
    """One unit per distinct run of the blocks ``probes`` of a document."""
    lists = probes.groupBy("doc", "row").agg(F.collect_set(F.struct("first", "last")).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = (batch.column(at).to_numpy() for at in (0, 1))
            texts, wanted = [_text(text) for text in batch.column(2)], batch.column(3)
            for one, end in packs([len(text) for text in texts]):
                words, low = _words_of(texts[one:end])
                runs, lists = Runs(words), wanted.slice(one, end - one)
                text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                first, last = (lists.flatten().field(at).to_numpy().astype(np.int64) for at in (0, 1))
                block, start = _spread(last - first + 1)
                text, start = text[block], start + first[block]
                place = start + low[text]
                half = place + size // 2
                tokens = [runs.hashes(place, half), runs.hashes(half, place + size), words[place]]
                once = _once(*tokens[:2], text)
                own, start = text[once] + one, start[once]
                yield _units([*(part[once].view(np.int64) for part in tokens), docs[own], rows[own], start, start, start])

    joined = named.select("doc", "row", "text").join(lists, ["doc", "row"])
    return joined.mapInArrow(run, UNITS)


def shared_runs(docs: DataFrame, size: int = RUN_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """``doc, row``: names of the documents with a run of words that another has too."""
    named = _named(docs)
    first = written(neighbours(written(_block_units(named, size, gram), "word-blocks")), "word-blocks")
    second = neighbours(written(_run_units(named, first.where("kin"), size), "word-runs"))
    found = [part.where("twin").select("doc", "row") for part in (first, second)]
    return written(found[0].unionByName(found[1]).distinct(), "shared-runs")
