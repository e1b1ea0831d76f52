"""Quality score of a text: histogram gradient-boosted trees over document statistics.

``fit_trees`` bins each statistic of a bounded labelled sample into quantile
histograms and boosts depth-limited trees on the logistic loss: a level's split
comes from sums of gradients per node, statistic and bin.  The fitted trees are
complete binary trees in flat arrays (split statistic, threshold, leaf value),
so scoring walks all rows through all trees a level at a time, in numpy.

The sample is at most ``FIT_DOCUMENTS`` labelled documents (least hash of the
key).  Everything else reads every document and whole texts: statistics are
made per text, so a batch never holds more than its texts and one row of numbers
each.  The score is the smoothed odds of label 1 of the trees; key, source and
language are not among the statistics.

Cases: a null text is an empty one and has a score of its own; labels of null
key or value are ignored, and of several labels of a key the least holds;
without labels of both kinds nothing can be learned and every score is 0.5; rows
with equal keys are scored one by one; extra columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.llm.labelled import held_out, labelled_sample

FIT_DOCUMENTS = 20_000
ACCEPT = 0.7
_LETTERS = str.maketrans("", "", "0123456789 \t\n\x0b\x0c\r.,;:!?'\"()[]{}<>|/\\@#$%^&*-_=+`~")

STATISTICS = (
    "chars", "words", "word length", "long words", "one-letter words", "distinct words",
    "top word", "same word twice running", "distinct pairs", "upper-case words",
    "capitalised words", "digits", "symbols", "exclamations", "pipes", "stops", "commas",
    "lines", "repeated lines", "words per line", "lines that end a sentence", "longest word",
    "letters", "worst tenth: distinct words", "worst tenth: symbols", "worst tenth: upper case",
)


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth in flat arrays; ``base`` is the prior's log odds."""

    base: float
    split: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray


def statistics(text: str) -> list[float]:
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [float(size)] + [0.0] * (len(STATISTICS) - 1)
    count = text.count
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    upper = np.fromiter((word.isupper() and len(word) > 1 for word in words), bool, n)
    symbols = sum(map(count, "#*$%&<>|"))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    same = sum(map(str.__eq__, words, words[1:]))
    # The worst of ten stretches shows a text that is only partly junk.
    step = max(20, -(-n // 10))
    parts = [(words[at : at + step], upper[at : at + step]) for at in range(0, max(1, n - step // 2), step)]
    marks = [sum(map(" ".join(part).count, "#*$%&<>|!")) / len(part) for part, _ in parts]
    return [
        float(size), float(n), lengths.mean(), (lengths > 10).mean(), (lengths == 1).mean(),
        len(counts) / n, max(counts.values()) / n, same / n, pairs / max(1, n - 1), upper.mean(),
        sum(map(str.istitle, words)) / n, sum(map(count, "0123456789")) / size, symbols / size,
        count("!") / n, count("|") / n, count(".") / n, count(",") / n, float(len(lines)),
        1 - len(set(lines)) / len(lines), n / len(lines),
        sum(line.rstrip().endswith((".", "!", "?")) for line in lines) / len(lines),
        float(lengths.max()), len(text.translate(_LETTERS)) / size,
        min(len(set(part)) / len(part) for part, _ in parts), max(marks),
        max(up.mean() for _, up in parts),
    ]


def fit_trees(
    rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64,
    rate: float = 0.15, ridge: float = 2.0, least: int = 10,
) -> Trees | None:
    """Boosted trees for ``labels`` 0 and 1; ``None`` without both."""
    n, width = rows.shape
    if n == 0 or labels.min() == labels.max():
        return None
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    codes = np.stack([np.searchsorted(cut, rows[:, f], side="left") for f, cut in enumerate(cuts)], 1)
    edges = np.full((width, bins), np.inf)
    for f, cut in enumerate(cuts):
        edges[f, : len(cut)] = cut
    base = float(np.log(labels.mean() / (1 - labels.mean())))
    odds = np.full(n, base)
    nodes = 2**depth - 1
    split, threshold = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf)
    leaf = np.zeros((trees, 2**depth))
    columns = np.arange(width)
    for tree in range(trees):
        chance = 1 / (1 + np.exp(-odds))
        slope, bend = labels - chance, chance * (1 - chance)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            here = 2**level
            at = ((node * width)[:, None] + columns) * bins + codes
            flat, size = at.ravel(), here * width * bins
            sums = [
                np.bincount(flat, np.repeat(values, width), size).reshape(here, width, bins).cumsum(2)
                for values in (slope, bend, np.ones(n))
            ]
            (g, h, c), (gt, ht, ct) = sums, (x[:, :, -1:] for x in sums)
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(c < least) | (ct - c < least)] = 0
            best = gain.reshape(here, -1).argmax(1)
            feature, cut = best // bins, best % bins
            useful = gain.reshape(here, -1)[np.arange(here), best] > 1e-9
            slots = here - 1 + np.arange(here)
            split[tree, slots] = feature
            threshold[tree, slots] = np.where(useful, edges[feature, cut], np.inf)
            right = rows[np.arange(n), feature[node]] > threshold[tree, slots][node]
            node = 2 * node + right
        g, h = np.bincount(node, slope, 2**depth), np.bincount(node, bend, 2**depth)
        leaf[tree] = rate * g / (h + ridge)
        odds += leaf[tree][node]
    return Trees(base, split, threshold, leaf)


def score_rows(model: Trees | None, rows: np.ndarray) -> np.ndarray:
    """Chance of label 1 of each row: all rows through all trees, level by level."""
    if model is None:
        return np.full(len(rows), 0.5)
    trees, nodes = model.split.shape
    which = np.arange(trees)
    node = np.zeros((len(rows), trees), np.int64)
    while True:
        feature = model.split[which, node]
        over = np.take_along_axis(rows, feature, 1) > model.threshold[which, node]
        node = 2 * node + 1 + over
        if node.size == 0 or node.flat[0] >= nodes:
            break
    odds = model.base + model.leaf[which, node - nodes].sum(1)
    return 1 / (1 + np.exp(-odds))


def _statistics_of(texts: pa.Array) -> np.ndarray:
    found = np.zeros((len(texts), len(STATISTICS)))
    for at, text in enumerate(texts):
        found[at] = statistics(text.as_py() or "")
    return found


def fit_quality(docs: DataFrame, labels: DataFrame) -> Trees | None:
    """Fit to ``labels(doc_id, quality)`` of the keys that are not held out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row.tobytes() for row in _statistics_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.binary()), batch.column(1)], ["row", "quality"]
            )

    sample = labelled_sample(docs, labels, FIT_DOCUMENTS).select("text", "quality")
    found = sample.mapInArrow(read, "row binary, quality int").toArrow()
    # Fixed order: the sums of the fit then do not depend on the tasks' order.
    packed = sorted(zip(found.column("row").to_pylist(), found.column("quality").to_pylist()))
    rows = np.frombuffer(b"".join(row for row, _ in packed)).reshape(-1, len(STATISTICS))
    return fit_trees(rows, np.array([quality for _, quality in packed], float))


def score_quality(docs: DataFrame, model: Trees | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_rows(model, _statistics_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(scores)], ["doc_id", "score"]
            )

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, model: Trees | None) -> DataFrame:
    """The rows of ``docs`` that the model accepts; all of them if there is no model."""
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_rows(model, _statistics_of(batch.column(at))) >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(docs, fit_quality(docs, labels))
