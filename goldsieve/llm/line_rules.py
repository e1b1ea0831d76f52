"""Quality rules whose last word is a line labelling by a conditional random field.

Fixed rules first: words, symbols, repeated lines, repeated three-word windows.
Then the lines of a text form one sequence.  Each line has a few yes/no
features; a linear-chain conditional random field with the labels boilerplate
(0) and content (1) scores feature and label pairs and neighbouring labels, and
Viterbi decoding finds the best labelling.  A document is kept if at least
``CONTENT_SHARE`` of its words stand in content lines.

The field is fitted to labelled documents by gradient ascent on its log-likelihood.
Labels are of documents, not of lines, so lines are labelled in turns: a line first
takes its document's label; then, ``RELABEL_ROUNDS`` times, emissions alone are fitted
and each line takes the label that they give it, one line at least keeping its
document's.  Only then is the whole field fitted: with neighbours from the start, a
text would never change its label.  Changes are learned from composed sequences as
well: the lines of an accepted document followed by those of a rejected one, or the
other way round.  The fit sees at most
``FIT_DOCUMENTS`` documents, those with the least hash of their key, and of a
document at most ``FIT_LINES`` lines, evenly spread: a bounded sample.  Decoding
reads every line of every text.

Cases: a null or empty text has no words and fails the base rules; a line without
a word is not part of the sequence; labels of null key or value are ignored and
of several labels of a key the least holds; without labels of both kinds every
line counts as content; rows with equal keys are judged one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.llm.labelled import labelled_sample

FIT_DOCUMENTS = 4000
FIT_LINES = 40
RELABEL_ROUNDS = 2
CONTENT_SHARE = 0.5
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_ENDS = tuple(".!?:;\"')]")

FEATURES = (
    "always", "few words", "many words", "ends a sentence", "starts upper case",
    "short words", "long words", "symbols 2 %", "symbols 10 %", "upper case 30 %",
    "exclamations", "digits 20 %", "seen before", "repeats words", "repeats most words",
    "pipes", "stops and commas",
)


@dataclass(frozen=True)
class LineField:
    """Weights of a fitted field: ``emit`` per feature and label, ``move`` per label pair."""

    emit: np.ndarray
    move: np.ndarray


def line_features(line: str, words: list[bytes], repeated: bool) -> list[bool]:
    n, size = len(words), max(1, len(line))
    marks = sum(map(line.count, SYMBOLS)) / size
    letters = sum(map(len, words)) / n
    upper = sum(word.isupper() for word in words) / n
    digits = sum(map(line.count, "0123456789")) / size
    distinct = len(set(words)) / n
    return [
        True, n < 4, n > 60, line.rstrip(_BLANKS).endswith(_ENDS), line.lstrip(_BLANKS)[:1].isupper(),
        letters < 3, letters > 9, marks > 0.02, marks > 0.1, upper > 0.3,
        line.count("!") > 0.05 * n, digits > 0.2, repeated, n >= 6 and distinct < 0.6,
        n >= 6 and distinct < 0.3, "|" in line, line.count(",") + line.count(".") > 0.02 * n,
    ]


def text_lines(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature rows and word counts of the lines with a word; how many repeat."""
    seen: set[str] = set()
    rows, sizes, repeats = [], [], 0
    for line in text.split("\n"):
        words = line.encode("utf-8", "surrogatepass").split()
        if words:
            again = line in seen
            repeats += again
            seen.add(line)
            rows.append(line_features(line, words, again))
            sizes.append(len(words))
    return np.array(rows, float).reshape(-1, len(FEATURES)), np.array(sizes, np.int64), repeats


def viterbi(field: LineField, features: np.ndarray) -> np.ndarray:
    """The best label of each line."""
    scores = features @ field.emit
    back = np.zeros(scores.shape, np.int8)
    best0, best1 = scores[0]
    (m00, m01), (m10, m11) = field.move
    for at in range(1, len(scores)):
        a0, b0, a1, b1 = best0 + m00, best1 + m10, best0 + m01, best1 + m11
        back[at] = b0 > a0, b1 > a1
        best0, best1 = max(a0, b0) + scores[at, 0], max(a1, b1) + scores[at, 1]
    labels = np.zeros(len(scores), np.int8)
    labels[-1] = best1 > best0
    for at in range(len(scores) - 1, 0, -1):
        labels[at - 1] = back[at, labels[at]]
    return labels


def fit_field(
    documents: list[tuple[np.ndarray, np.ndarray | int]], rounds: int = 200, chain: bool = True
) -> LineField | None:
    """Gradient ascent on the mean log-likelihood per line, all documents at once.

    A document has a label for each line, or one for all.  Forward and backward sums
    run over padded sequences; ``None`` without both labels.  Without ``chain`` lines
    do not know their neighbours.
    """
    documents = [(rows, np.broadcast_to(label, len(rows))) for rows, label in documents if len(rows)]
    if len(set().union(*(set(label.tolist()) for _, label in documents))) < 2:
        return None
    n, longest = len(documents), max(len(rows) for rows, _ in documents)
    features = np.zeros((n, longest, len(FEATURES)))
    there = np.zeros((n, longest), bool)
    gold = np.full((n, longest), -1)
    for at, (rows, label) in enumerate(documents):
        features[at, : len(rows)], there[at, : len(rows)], gold[at, : len(rows)] = rows, True, label
    lines = there.sum(1)
    # Both classes of lines count alike, however many of each the sample holds.
    each = np.where(gold == 1, 0.5 / (gold == 1).sum(), 0.5 / (gold == 0).sum()) * there
    weight = each.sum(1) / lines
    emit, move = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    step_e, step_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    pairs = there[:, 1:]
    seen_e, seen_m = np.zeros_like(emit), np.zeros_like(move)
    for label in (0, 1):
        mine = gold == label
        seen_e[:, label] = np.einsum("n,nl,nlf->f", weight, mine, features)
        for after in (0, 1):
            seen_m[label, after] = (weight[:, None] * (mine[:, :-1] & (gold[:, 1:] == after))).sum()
    for _ in range(rounds):
        scores = features @ emit
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for at in range(1, longest):
            moved = np.logaddexp.reduce(ahead[:, at - 1, :, None] + move, axis=1) + scores[:, at]
            ahead[:, at] = np.where(there[:, at, None], moved, ahead[:, at - 1])
        for at in range(longest - 2, -1, -1):
            onward = np.logaddexp.reduce(
                move + (scores[:, at + 1] + behind[:, at + 1])[:, None, :], axis=2
            )
            behind[:, at] = np.where(there[:, at + 1, None], onward, 0.0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        share = np.exp(ahead + behind - total[:, None, None]) * there[:, :, None]
        both = np.exp(
            ahead[:, :-1, :, None] + move + (scores[:, 1:] + behind[:, 1:])[:, :, None, :]
            - total[:, None, None, None]
        ) * pairs[:, :, None, None]
        up_e = seen_e - np.einsum("n,nlf,nlk->fk", weight, features, share) - 1e-4 * emit
        up_m = seen_m - np.einsum("n,nljk->jk", weight, both) - 1e-4 * move
        step_e, step_m = step_e + up_e**2, step_m + up_m**2
        emit = emit + 0.5 * up_e / np.sqrt(step_e)
        move = move + 0.5 * up_m / np.sqrt(step_m) * chain
    return LineField(emit, move)


def relabelled(field: LineField, rows: np.ndarray, label: int) -> np.ndarray:
    """The decoded labels of a document's lines, one at least being the document's own."""
    found = viterbi(field, rows)
    if len(found) and not (found == label).any():
        scores = rows @ field.emit
        found[np.argmax(scores[:, label] - scores[:, 1 - label])] = label
    return found


def composed(documents: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lines of an accepted and a rejected document in one sequence, in either order."""
    good = [part for part, label in zip(documents, labels) if label == 1]
    bad = [part for part, label in zip(documents, labels) if label == 0]
    out = []
    for at, pair in enumerate(zip(good, bad)):
        first, second = pair if at % 2 else pair[::-1]
        half = FIT_LINES // 2
        rows = np.concatenate((first[0][-half:], second[0][:half]))
        out.append((rows, np.concatenate((first[1][-half:], second[1][:half]))))
    return out


def fit_lines(documents: list[tuple[np.ndarray, int]]) -> LineField | None:
    """A field that labels lines, from documents with one label each."""
    documents = [(rows, label) for rows, label in documents if len(rows)]
    labels = [label for _, label in documents]
    lines = [(rows, np.full(len(rows), label)) for rows, label in documents]
    for _ in range(RELABEL_ROUNDS):
        field = fit_field(lines, 60, chain=False)
        if field is None:
            return None
        lines = [(rows, relabelled(field, rows, label)) for rows, label in documents]
    return fit_field(lines + composed(lines, labels))


def fit_line_field(docs: DataFrame, labels: DataFrame) -> LineField | None:
    """Fit to the labelled documents of ``labels(doc_id, quality)``."""
    sample = labelled_sample(docs, labels, FIT_DOCUMENTS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0):
                features, _, _ = text_lines(text.as_py() or "")
                every = np.linspace(0, len(features) - 1, min(FIT_LINES, len(features))).astype(int)
                rows.append(np.packbits(features[every].astype(np.uint8), axis=1).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.binary()), batch.column(1)], ["lines", "quality"]
            )

    found = sample.select("text", "quality").mapInArrow(read, "lines binary, quality int").collect()
    width = math.ceil(len(FEATURES) / 8)
    return fit_lines(
        [
            (
                np.unpackbits(
                    np.frombuffer(row["lines"], np.uint8).reshape(-1, width), axis=1, count=len(FEATURES)
                ).astype(float),
                row["quality"],
            )
            for row in found
        ]
    )


def repeated_window_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur at least twice in the text."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(word, len(ids)) for word in words], np.int64)
    pairs = codes[:-1] * len(ids) + codes[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1].astype(np.int64) * len(ids) + codes[2:]
    _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
    twice = times[place] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


RESULT = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, content_words bigint"
)


def judge_lines(docs: DataFrame, field: LineField | None) -> DataFrame:
    """Counts and verdict of every whole text of ``docs(doc_id, text)``."""

    def judge(text: str) -> tuple:
        words = text.encode("utf-8", "surrogatepass").split()
        n = len(words)
        chars = len(text) - sum(map(text.count, _BLANKS))
        features, sizes, dup_lines = text_lines(text)
        repeats = repeated_window_words(words)
        failed = n < MIN_WORDS or 100 * repeats > 50 * n
        content = n
        if n and field is not None:
            content = int(sizes[viterbi(field, features) == 1].sum())
        kept = not failed and content >= CONTENT_SHARE * n
        return n, chars, sum(map(text.count, SYMBOLS)), dup_lines, repeats, failed, kept, content

    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
    names = [part.split()[0] for part in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(text.as_py() or "") for text in batch.column(1)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [
                pa.array([], t) for t in types
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, RESULT)


def line_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge_lines(docs, fit_line_field(docs, labels))
