import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from goldsieve.llm import passages
from goldsieve.llm.fm_index import Index, WaveletTree, suffix_order
from goldsieve.llm.passages import blocks, repeated_windows, stretches, without_passages, word_hashes, word_spans


def _brute(rows, window):
    words = [(key, (text or "").encode().split()) for key, text in rows]
    seen = Counter(tuple(w[at : at + window]) for _, w in words for at in range(len(w) - window + 1))
    out = []
    for key, w in words:
        gone = [False] * len(w)
        for at in range(len(w) - window + 1):
            if seen[tuple(w[at : at + window])] > 1:
                gone[at : at + window] = [True] * window
        kept = b" ".join(word for word, off in zip(w, gone) if not off)
        spans = sum(off and not before for off, before in zip(gone, [False, *gone]))
        out.append((key, len(w), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def _check(docs, window, grams):
    rows = [(row["doc_id"], row["text"]) for row in docs.select("doc_id", "text").collect()]
    got = [(*tuple(row)[:5], bytes(row["kept"])) for row in without_passages(docs, window, grams).collect()]
    wanted = _brute(rows, window)
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))
    return wanted


def _sequences(parts):
    symbols = np.concatenate([np.append(part, 0) for part in parts])
    ends = np.cumsum([len(part) + 1 for part in parts]) - 1
    return symbols, ends - [len(part) for part in parts], ends


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    for count in (2, 3, 70):
        symbols = rng.integers(0, count, 300)
        tree = WaveletTree(symbols, count)
        at = np.arange(301)
        for symbol in range(count):
            wanted = np.concatenate(([0], np.cumsum(symbols == symbol)))
            assert tree.rank(np.full(301, symbol), at).tolist() == wanted.tolist()


def test_suffix_order_and_common_prefixes():
    rng = random.Random(2)
    for _ in range(30):
        symbols, _, _ = _sequences([np.array([rng.randint(1, 2) for _ in range(rng.randint(1, 20))]) for _ in range(4)])
        apart = [(0, n) if symbol == 0 else (1, int(symbol)) for n, symbol in enumerate(symbols)]
        order, common = suffix_order(symbols)
        assert order.tolist() == sorted(range(len(symbols)), key=lambda at: apart[at:])
        for n in range(1, len(order)):
            one, two = apart[order[n - 1] :], apart[order[n] :]
            agreed = next((k for k, (a, b) in enumerate(zip(one, two)) if a != b), min(len(one), len(two)))
            assert common[n] == agreed


def test_matching_statistics():
    rng = np.random.default_rng(3)
    for turn in range(40):
        parts = [rng.integers(1, 4, int(rng.integers(1, 25))) for _ in range(int(rng.integers(1, 6)))]
        parts += parts[: turn % 2]
        symbols, starts, ends = _sequences(parts)
        found = Index(symbols, 4).matching(symbols, starts, ends)
        times = Counter(tuple(p[a:b].tolist()) for p in parts for a in range(len(p)) for b in range(a + 1, len(p) + 1))
        for start, end in zip(starts, ends):
            for at in range(start, end):
                lengths = [b - at for b in range(at + 1, end + 1) if times[tuple(symbols[at:b].tolist())] > 1]
                assert found[at] == max(lengths, default=0)


def test_repeated_windows_of_a_shard():
    one, two = b"a b c d e f g", b"x b c d e f y"
    assert repeated_windows([one, two], [False, False], 5) == [[(1, 1)], [(1, 1)]]
    assert repeated_windows([one, two], [False, False], 6) == [[], []]
    assert repeated_windows([one, two], [True, False], 6) == [[(0, 1)], []]


def test_equal_windows_have_equal_grams():
    rng = random.Random(4)
    common = [rng.choice("abcde") for _ in range(200)]
    found = []
    for n in (0, 3, 40):
        words = [rng.choice("abcde") for _ in range(n)] + common
        grams = {}
        for part in blocks(word_hashes(" ".join(words).encode()), 4, 12):
            for g, _, first, last in zip(*(column.tolist() for column in part)):
                grams |= {at - n: g for at in range(first, last + 1)}
        found.append([grams[at] for at in range(200 - 11)])
    assert found[0] == found[1] == found[2]


def test_words_and_stretches(monkeypatch):
    text = " a\t\tbä  c\n\x0bdd \x85 e ".encode()
    starts, ends = word_spans(np.frombuffer(text, np.uint8))
    assert [text[a:b] for a, b in zip(starts, ends)] == text.split()
    whole = word_hashes(text).tolist()
    monkeypatch.setattr(passages, "STRETCH_BYTES", 3)
    assert len(list(stretches(text))) > 3
    assert word_hashes(text).tolist() == whole
    assert b"".join(text[a:b] for a, b in stretches(text)) == text


def _texts(rng, n):
    stock = [[rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(8, 40))] for _ in range(6)]
    rows = []
    for key in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(stock) if rng.random() < 0.5 else [str(rng.randint(0, 60)) for _ in range(rng.randint(0, 20))]
        if words and rng.random() < 0.3:
            words[rng.randrange(len(words))] = "Z"
        rows.append((key, rng.choice([" ", "  ", "\n"]).join(words)))
    return rows


def test_random_texts(docs_of):
    wanted = _check(docs_of(_texts(random.Random(5), 80)), 12, (4, 7, 12))
    assert 0 < sum(row[2] for row in wanted) < sum(row[1] for row in wanted)


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_grams_are_cut_anew(docs_of, monkeypatch, hot):
    """The grams around the edges of a common passage have many distinct segments."""
    monkeypatch.setattr(passages, "HOT", hot)
    rng = random.Random(6)
    passage = [f"w{n}" for n in range(30)]
    rows = [
        (n, " ".join([str(rng.randint(0, 3)) for _ in range(15)] + passage + [str(rng.randint(0, 3)) for _ in range(15)]))
        for n in range(60)
    ]
    _check(docs_of(rows + _texts(rng, 30)[20:]), 12, (4, 7, 12))


def test_periodic_texts_and_large_groups(docs_of, monkeypatch):
    monkeypatch.setattr(passages, "SHARD_WORDS", 200)
    rows = [(n, "a b " * (8 + n)) for n in range(5)] + [(9, "a " * 40), (10, "a " * 12), (11, "a " * 11)]
    rows += [(100 + n, "the passage that very many documents share is of a certain length indeed " + str(n)) for n in range(200)]
    _check(docs_of(rows), 12, (4, 7, 12))


def test_odd_rows_none_and_clashing_columns(odd_docs):
    _check(odd_docs.where("doc_id IS NULL OR doc_id < 9"), 35, (8, 20, 35))
    assert without_passages(odd_docs.where("false")).count() == 0
    more = odd_docs.where("doc_id < 8").selectExpr("*", "1 AS row", "2 AS doc", "3 AS g", "4 AS ranges", "5 AS words")
    assert without_passages(more).count() == odd_docs.where("doc_id < 8").count()
