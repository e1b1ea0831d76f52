import itertools
import random
import re

import pytest

from goldsieve.llm import decontamination as module
from goldsieve.llm.decontamination import MASKS, MIN_PERCENT, MIN_WORDS, WINDOW, decontamination, drop_contaminated


def _words(text):
    return [word for word in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if word]


def _overlap(text, item):
    """Best window of the item on any diagonal of the text."""
    doc, wanted = _words(text), _words(item)
    size, best = min(WINDOW, len(wanted)), 0
    for diagonal in range(-len(wanted) + 1, len(doc)):
        same = [0 <= at + diagonal < len(doc) and doc[at + diagonal] == word for at, word in enumerate(wanted)]
        best = max(best, *(sum(same[at : at + size]) for at in range(len(wanted) - size + 1)))
    return best / size if best * 100 >= size * MIN_PERCENT else 0.0


def test_masks_leave_no_gap():
    for size in range(12, WINDOW + 1):
        places = [
            frozenset(start + offset for offset in mask)
            for mask in MASKS
            for start in range(size - mask[-1])
        ]
        for changed in itertools.combinations(range(size), size * (100 - MIN_PERCENT) // 100):
            assert any(not place.intersection(changed) for place in places), (size, changed)


def test_masks_leave_no_gap_in_short_items():
    for size in range(MIN_WORDS, 12):
        places = [
            frozenset(start + offset for offset in mask)
            for mask in MASKS
            for start in range(size - mask[-1])
        ]
        for changed in itertools.combinations(range(size), size * (100 - MIN_PERCENT) // 100):
            assert any(not place.intersection(changed) for place in places), (size, changed)


@pytest.fixture
def fixture(spark, docs_of):
    rng = random.Random(1)
    vocabulary = [f"w{n}" for n in range(40)] + ["été", "ñu"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(n, text(rng.choice([3, 9, 12, 15, 20, 31, 45]))) for n in range(30)]
    rows = []
    for key in range(150):
        words = text(rng.randint(0, 60))
        if rng.random() < 0.7:
            passage = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, len(passage) // 4))):
                passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
            at = rng.randint(0, len(words))
            words[at:at] = passage[: rng.choice([len(passage), len(passage), 14])]
        rows.append((key, rng.choice([" ", ", ", "\n"]).join(words).capitalize()))
    bench = [(n, " ".join(words)) for n, words in items] + [(None, None), (77, None), (78, "")]
    return rows, docs_of(rows), spark.createDataFrame(bench, "item_id bigint, text string"), items


@pytest.mark.parametrize("few", [0, 2_000_000])
def test_every_overlap_is_found(fixture, monkeypatch, few):
    monkeypatch.setattr(module, "BROADCAST_SEEDS", few)
    rows, docs, bench, items = fixture
    found = {row["doc_id"]: row for row in decontamination(docs, bench).collect()}
    assert len(found) == len(rows)
    for key, text in rows:
        # Items below twelve words may hide behind substitutions; exact ones never do.
        scores = {n: _overlap(text, " ".join(words)) for n, words in items if len(words) >= 12}
        exact = {n for n, words in items if len(words) in (3, 9) and _overlap(text, " ".join(words)) == 1.0}
        scores |= {n: 1.0 for n in exact}
        sure = {n for n, score in scores.items() if score} | exact
        row = found[key]
        short = {n for n, words in items if len(words) == 9 and _overlap(text, " ".join(words))}
        assert len(sure) <= row["n_items"] <= len(sure | short)
        assert row["contaminated"] == (row["n_items"] > 0)
        if sure and not short:
            assert row["overlap"] == max(scores[n] for n in sure) and row["first_item"] == min(sure)
    kept = {row["doc_id"] for row in drop_contaminated(docs, bench).collect()}
    assert kept == {key for key in found if not found[key]["contaminated"]}


def test_every_length_and_choice_of_places(spark, docs_of):
    """Items of 1 to 20 words, exact and with every allowed (or, from 12, some) choice of words changed."""
    rng, rows, wanted = random.Random(4), [], {}
    items = {size: [f"i{size}w{at}" for at in range(size)] for size in range(1, 21)}
    for size, item in items.items():
        choices = list(itertools.combinations(range(size), size * (100 - MIN_PERCENT) // 100))
        for changed in [(), *(choices if size < 12 else rng.sample(choices, 20))]:
            text = " ".join("other" if at in changed else word for at, word in enumerate(item))
            rows.append((len(rows), f"before it {text} after it"))
            wanted[rows[-1][0]] = size >= MIN_WORDS or not changed
            assert _overlap(text, " ".join(item)) > 0
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id bigint, text string")
    found = {row["doc_id"]: row["contaminated"] for row in decontamination(docs_of(rows), bench).collect()}
    assert found == wanted


def test_native_plan(fixture):
    _, docs, bench, _ = fixture
    plan = decontamination(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


def test_odd_rows_and_none(odd_docs, fixture):
    _, docs, bench, _ = fixture
    assert decontamination(odd_docs, bench).where("contaminated").count() == 0
    assert decontamination(odd_docs, bench).count() == odd_docs.count()
    assert decontamination(docs.where("false"), bench).count() == 0
    assert decontamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert drop_contaminated(odd_docs, bench).count() == odd_docs.count()
    more = docs.selectExpr("*", "1 AS bad_doc", "2 AS words", "3 AS `a.b`", "4 AS hits")
    left = drop_contaminated(more, bench)
    assert left.columns == more.columns and left.count() == drop_contaminated(docs, bench).count()
