import hashlib
import random
from collections import Counter

import numpy as np

from goldsieve.llm import passages, suffixes, word_runs
from goldsieve.llm.suffixes import blocks, multikey_order, window_minima, without_repeats
from goldsieve.llm.word_runs import shared_runs


def _brute(rows, length):
    seen = Counter(
        data[at : at + length]
        for _, text in rows
        for data in [(text or "").encode()]
        for at in range(len(data) - length + 1)
    )
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for at in range(len(data) - length + 1):
            if seen[data[at : at + length]] > 1:
                gone[at : at + length] = [True] * length
        kept = bytes(byte for byte, off in zip(data, gone) if not off)
        spans = sum(off and not before for off, before in zip(gone, [False, *gone]))
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def _check(docs, length, gram):
    rows = [(row["doc_id"], row["text"]) for row in docs.select("doc_id", "text").collect()]
    got = [(*tuple(row)[:5], bytes(row["kept"])) for row in without_repeats(docs, length, gram).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, _brute(rows, length)))


def test_multikey_order():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 30_000):
        words = [rng.integers(-3, 3, n), rng.integers(-(1 << 62), 1 << 62, n) // (1 << 60), rng.integers(0, 9, n)]
        assert (np.stack(words)[:, multikey_order(words)] == np.stack(words)[:, np.lexsort(words[::-1])]).all()


def test_window_minima():
    values = np.random.default_rng(2).integers(0, 99, 200, dtype=np.uint64)
    for width in (1, 2, 7, 199, 200):
        wanted = [values[at : at + width].min() for at in range(201 - width)]
        assert window_minima(values, width).tolist() == wanted


def test_equal_strings_have_equal_anchors():
    rng = random.Random(3)
    common = bytes(rng.choice(b"abc ") for _ in range(300))
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) + common for n in (0, 17, 50)]
    offsets = []
    for text in texts:
        anchor = np.zeros(len(text), int)
        for _, _, _, first, last, at in blocks(np.frombuffer(text, np.uint8), 40, 12):
            for low, high, place in zip(first, last, at):
                anchor[low : high + 1] = place
        starts = np.arange(len(text) - 300, len(text) - 39)
        offsets.append((anchor[starts] - starts).tolist())
    assert offsets[0] == offsets[1] == offsets[2]


def test_random_texts(docs_of):
    rng = random.Random(4)
    passages = ["".join(rng.choice("ab cdé") for _ in range(rng.randint(20, 90))) for _ in range(6)]
    rows = []
    for key in range(60):
        parts = [
            rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60)))
            for _ in range(rng.randint(0, 6))
        ]
        text = "".join(parts)
        if text and rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + "Z" + text[at:]
        rows.append((key, text))
    _check(docs_of(rows), 32, 12)


def test_periodic_texts_and_a_large_group(docs_of):
    rows = [(n, "ab" * (20 + n)) for n in range(5)] + [(10, "a" * 100), (11, "a" * 40), (12, "a" * 32)]
    rows += [(100 + n, "the passage that very many documents share, of a certain length " + str(n) * 3) for n in range(200)]
    _check(docs_of(rows), 32, 12)


def test_long_texts_cross_stretches(docs_of, monkeypatch):
    monkeypatch.setattr("goldsieve.llm.suffixes.STRETCH", 50)
    rng = random.Random(5)
    one = "".join(rng.choice("abcdef ") for _ in range(500))
    noise = ["".join(rng.choice("abcdef ") for _ in range(37)) for _ in range(2)]
    rows = [(1, one), (2, noise[0] + one[100:400] + noise[1]), (3, one[90:160])]
    found = {n: list(blocks(np.frombuffer(text.encode(), np.uint8), 32, 12)) for n, text in rows}
    assert len(found[1]) == 10
    _check(docs_of(rows), 32, 12)


def test_odd_rows_and_none(odd_docs):
    short = odd_docs.where("doc_id IS NULL OR doc_id < 8")
    _check(short, 400, 128)
    assert without_repeats(odd_docs).where("doc_id = 9").first()["n_spans"] == 1
    assert without_repeats(odd_docs.where("false")).count() == 0


def _shared(rows, size):
    """Whether a row has a run of words that another row has."""
    words = [(text or "").encode().split() for _, text in rows]
    runs = [{tuple(w[at : at + size]) for at in range(len(w) - size + 1)} for w in words]
    times = Counter(run for own in runs for run in own)
    return [(key, any(times[run] > 1 for run in own)) for (key, _), own in zip(rows, runs)]


def test_words_shared_with_other_documents(docs_of, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_UNITS", 100)
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 30))
    passages = [[word() for _ in range(rng.randint(8, 40))] for _ in range(5)]
    rows = [(900, "own " * 40), (901, " ".join(passages[0] * 3))]
    for key in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.4 else [word() for _ in range(rng.randint(0, 20))]
        rows.append((key, rng.choice([" ", "\n"]).join(words)))
    docs = docs_of(rows)
    found = without_repeats(docs, 64, 16, shared_runs(docs, 12, 4)).collect()
    wanted = _shared(rows, 12)
    assert sorted((row["doc_id"], row["shares_run"]) for row in found) == sorted(wanted)
    assert 10 < sum(shares for _, shares in wanted) < len(rows) and not dict(wanted)[900]
    assert without_repeats(docs, 64, 16).where("shares_run IS NOT NULL").count() == 0


def test_shared_words_of_odd_rows(odd_docs):
    short = odd_docs.where("doc_id IS NULL OR doc_id < 9")
    found = {(row["doc_id"], row["n_bytes"]): row["shares_run"] for row in without_repeats(short, runs=shared_runs(short)).collect()}
    assert found[5, 750] and found[6, 750] and not found[None, 0] and not found[1, 0] and not found[8, 1_000_000]
    none = odd_docs.where("false")
    assert without_repeats(none, runs=shared_runs(none)).count() == 0


def test_texts_hashed_together_are_as_hashed_alone(monkeypatch):
    monkeypatch.setattr(suffixes, "PACK", 2_000)
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcd") * rng.randint(1, 4) for _ in range(rng.choice([0, 3, 30, 200, 2_000]))).encode() for _ in range(80)]
    texts = [text + rng.choice([b"", b" ", b"\n"]) for text in texts]
    long = [np.frombuffer(text, np.uint8) for text in texts if len(text) >= 40]
    alone = [(n, *row) for n, text in enumerate(long) for found in blocks(text, 40, 12) for row in zip(*(c.tolist() for c in found))]
    many = list(suffixes.packed_blocks(long, 40, 12))
    assert sorted(alone) == sorted(row for found in many for row in zip(*(c.tolist() for c in found)))
    assert len(many) < len(long)
    alone = [(n, *row) for n, text in enumerate(texts) for found in passages.blocks(passages.word_hashes(text), 4, 12) for row in zip(*(c.tolist() for c in found))]
    many = list(word_runs.packed_blocks(texts, 4, 12))
    assert sorted(alone) == sorted(row for found in many for row in zip(*(c.tolist() for c in found)))
    assert len(many) < len(texts)
