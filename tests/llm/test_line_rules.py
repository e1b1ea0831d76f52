import itertools
import re
import zlib
from collections import Counter

import numpy as np

from goldsieve.llm.line_rules import (
    FEATURES,
    LineField,
    fit_field,
    fit_line_field,
    fit_lines,
    judge_lines,
    line_rules,
    text_lines,
    viterbi,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _base(text):
    text = text or ""
    words, lines = WORD.findall(text), text.split("\n")
    seen, repeated = set(), 0
    for line in lines:
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(words[at : at + 3]) for at in range(len(words) - 2)]
    times = Counter(windows)
    covered = {at + k for at, window in enumerate(windows) if times[window] > 1 for k in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return n, sum(map(len, words)), symbols, repeated, len(covered), failed


def test_base_counts(spark, folder, odd_docs):
    for docs in (spark.read.parquet(f"{folder}/documents.parquet"), odd_docs):
        wanted = sorted(map(repr, ((row["doc_id"], *_base(row["text"])) for row in docs.collect())))
        assert sorted(repr(tuple(row)[:7]) for row in judge_lines(docs, None).collect()) == wanted


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 8):
        rows = rng.integers(0, 2, (n, len(FEATURES))).astype(float)
        field = LineField(rng.normal(size=(len(FEATURES), 2)), rng.normal(size=(2, 2)))
        scores = rows @ field.emit

        def value(labels):
            return sum(scores[at, k] for at, k in enumerate(labels)) + sum(
                field.move[a, b] for a, b in zip(labels, labels[1:])
            )

        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(viterbi(field, rows)) == best


def test_fit_learns_emissions():
    rng = np.random.default_rng(6)
    documents = []
    for at in range(60):
        rows = rng.integers(0, 2, (rng.integers(1, 12), len(FEATURES))).astype(float)
        rows[:, 0], rows[:, 5] = 1, at % 2
        documents.append((rows, at % 2))
    field = fit_field(documents)
    assert all((viterbi(field, rows) == label).all() for rows, label in documents)
    assert fit_field(documents[::2]) is None and fit_field([]) is None


def test_lines_of_mixed_documents_are_told_apart():
    """Documents have one label, their lines two kinds; one in five lines is of the other kind."""
    rng = np.random.default_rng(7)

    def block(kind, n):
        rows = np.zeros((n, len(FEATURES)))
        rows[:, 0], rows[:, 1 + kind] = 1, rng.random(n) < 0.9
        return rows

    documents = []
    for at in range(200):
        kinds = np.where(rng.random(20) < 0.8, at % 2, 1 - at % 2)
        kinds = np.sort(kinds)[:: rng.choice([1, -1])]
        documents.append((np.concatenate([block(kind, 1) for kind in kinds]), at % 2))
    field = fit_lines(documents)
    right = []
    for _ in range(20):
        n, m = rng.integers(8, 30, 2)
        found = viterbi(field, np.concatenate((block(1, n), block(0, m), block(1, n))))
        right.append(np.mean(found == np.repeat([1, 0, 1], [n, m, n])))
    assert np.mean(right) > 0.9


def test_composed_texts(spark):
    """Good and rejected held-out texts put together: lines and share come out right."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    field = fit_line_field(docs, labels)
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()
    held = sorted((row["doc_id"], row["text"], row["quality"]) for row in rows if zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2 and row["text"])
    sides = [[text_lines(text)[:2] for _, text, quality in held if quality == label][:150] for label in (0, 1)]
    right, lines, shares, mixed = 0, 0, [], 0
    for at, (bad, good) in enumerate(zip(*sides)):
        parts = [(bad, 0), (good, 1)][:: 1 if at % 2 else -1]
        found = viterbi(field, np.concatenate([part[0] for part, _ in parts]))
        truth = np.concatenate([np.full(len(part[0]), label) for part, label in parts])
        sizes = np.concatenate([part[1] for part, _ in parts])
        right, lines = right + (found == truth).sum(), lines + len(truth)
        shares.append(sizes[found == 1].sum() / sizes.sum() - sizes[truth == 1].sum() / sizes.sum())
        mixed += 0 < found.sum() < len(found)
    assert right >= 0.9 * lines and mixed >= 0.8 * len(shares)
    assert abs(np.mean(shares)) < 0.05 and np.mean(np.abs(shares)) < 0.1


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = line_rules(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    rows = found.where("n_words >= 50").join(labels, "doc_id").select("doc_id", "kept", "quality").collect()
    held = [row for row in rows if zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2]
    assert np.mean([row["kept"] == (row["quality"] == 1) for row in held]) >= 0.95


def test_no_rows_no_labels(odd_docs, labels_of):
    assert line_rules(odd_docs.where("false"), labels_of([])).count() == 0
    assert line_rules(odd_docs, labels_of([(None, 1, 0), (1, None, 0)])).count() == odd_docs.count()
