import math
import random

import numpy as np

from goldsieve.llm import minhash
from goldsieve.llm.minhash import (
    BANDS,
    ROWS,
    components,
    could_be_similar,
    drop_near_duplicates,
    least_matches,
    near_duplicates,
    shingles,
    short_minima,
    signature,
    similar,
)


def _set(text, width=2):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return {tuple(words[at : at + width]) for at in range(len(words) - width + 1)} if words else set()


def _brute(rows, width=2):
    """Least reachable key of each row, by all pairs."""
    sets = [(key, _set(text, width)) for key, text in rows]
    parent = {key: key for key, _ in sets if key is not None}

    def find(key):
        while parent[key] != key:
            key = parent[key]
        return key

    for at, (one, a) in enumerate(sets):
        for two, b in sets[:at]:
            if None not in (one, two) and a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(one), find(two)))
                parent[high] = low
    return sorted(
        repr((key, len(found), None if key is None else find(key), key is None or find(key) == key))
        for key, found in sets
    )


def _check(docs, width=2):
    rows = [(row["doc_id"], row["text"]) for row in docs.select("doc_id", "text").collect()]
    assert sorted(repr(tuple(row)) for row in near_duplicates(docs, width).collect()) == _brute(rows, width)


def test_least_matches_is_the_posterior():
    for n in (48, 96, 240):
        m = least_matches(n, 1e-4)
        # Numerical tail of Beta(m + 1, n - m + 1) above 0.8, just below and at the bound.
        grid = np.linspace(0, 1, 200_001)
        for matches, wanted in ((m, True), (m - 1, False)):
            density = grid**matches * (1 - grid) ** (n - matches)
            assert (density[grid >= 0.8].sum() / density.sum() >= 1e-4) == wanted


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    for overlap in (0.5, 0.82, 0.95):
        n = int(2000 * 2 * overlap / (1 + overlap))
        one, two = values[:2000], values[2000 - n : 4000 - n]
        equal = (signature(one) == signature(two)).mean()
        assert abs(equal - overlap) < 4 * math.sqrt(overlap * (1 - overlap) / (BANDS * ROWS))
        assert similar(one, two) == (overlap >= 0.8)
        short = [short_minima(signature(values)) for values in (one, two)]
        assert len(could_be_similar(short[0], short[1][None])) == (overlap >= 0.8)


def test_shingles():
    assert len(shingles("")) == len(shingles(" \n")) == 0
    assert (shingles("A b") == shingles("a\tB")).all() and len(shingles("a")) == 1
    assert len(shingles("é É")) == 1 and shingles("é é") != shingles("É É")
    assert len(shingles("a b a b a")) == 2 and len(shingles("a b c", 5)) == 1


def test_groups_of_copies(docs_of, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, key = [], 0
    for group in range(12):
        base = [word() for _ in range(rng.choice([1, 2, 6, 30, 120]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = word()
            rows.append((key, " ".join(words)))
            key += 1
    rng.shuffle(rows)
    _check(docs_of(rows))
    # Tiny blocks: every bucket is cut into many.
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 1000)
    _check(docs_of(rows), 5)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 1 << 20)
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 3)
    _check(docs_of(rows))


def test_a_key_with_several_texts_joins_their_classes(docs_of):
    one, two = " ".join(f"a{n}" for n in range(30)), " ".join(f"b{n}" for n in range(30))
    _check(docs_of([(3, one), (3, two), (2, two), (1, one), (4, two + " end"), (9, "other words")]))


def test_one_row_of_a_component_stays_whatever_the_columns(docs_of):
    text = " ".join(f"a{n}" for n in range(30))
    docs = docs_of([(5, text), (5, text), (6, text + " more"), (7, "first"), (7, "second"), (8, "alone")])
    more = docs.selectExpr("*", "1 AS gone", "2 AS `key`", "3 AS node", "4 AS `odd.name`", "5 AS class")
    left = drop_near_duplicates(more)
    assert left.columns == more.columns
    assert sorted(row["doc_id"] for row in left.collect()) == [5, 7, 8]


def test_a_chain_is_one_component(docs_of):
    words = [f"w{n}" for n in range(120)]
    # Neighbours share about 0.86, every second one less than 0.8.
    rows = [(50 - n, " ".join(words[8 * n % 16 + n * 4 : 8 * n % 16 + n * 4 + 80])) for n in range(8)]
    _check(docs_of(rows))
    chain = [(n, " ".join(f"v{k}" for k in range(6 * n, 6 * n + 100))) for n in range(12)]
    _check(docs_of(chain))


def test_components_follow_long_paths(spark):
    n = 40
    labels = spark.createDataFrame([(k, k) for k in range(n + 3)], "node bigint, label bigint")
    links = spark.createDataFrame([(k, k + 1) for k in range(n - 1)] + [(n, n + 2)], "a bigint, b bigint")
    found = {row["node"]: row["label"] for row in components(labels, links).collect()}
    assert found == {k: 0 for k in range(n)} | {n: n, n + 1: n + 1, n + 2: n}


def test_odd_rows_and_none(odd_docs):
    _check(odd_docs)
    assert near_duplicates(odd_docs.where("false")).count() == 0
    left = drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns and left.where("doc_id = 6").count() == 0
    assert left.where("doc_id IS NULL").count() == 2
