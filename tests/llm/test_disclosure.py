import hashlib
import math
import random
import re

import pytest

from goldsieve.llm import disclosure
from goldsieve.llm.disclosure import base_spans, disclosing_terms, personal_data

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def _luhn(digits):
    doubled = [int(d) * 2 if at % 2 else int(d) for at, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _plain(text):
    found = []
    for kind, pattern in PATTERNS:
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            if kind == "ip" and any(int(part) > 255 for part in match[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *match.span()))
    return found


def test_base_spans_are_the_patterns():
    rng = random.Random(1)
    pieces = ["a", "b.c", "@", "@@", ".", "1", "25", "256", "0000255", "1.2.3.4", "+", "+1 ", "-", " ", "(5)", "é", "%+-",
              "4111 1111 1111 1111", "a@b.c", "x@y", "\n", "378282246310005", "..", "12-34"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert base_spans(text) == _plain(text), text


def test_long_runs_stay_linear():
    for run in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 300_000, "+1" + " " * 300_000, "a@" * 150_000):
        base_spans(run)


ENTITY = "reach jo@example.org today"


def _rows():
    """One term always stands by one address, in different surroundings."""
    rng, rows = random.Random(2), []
    for key in range(40):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30)]
        if key < 5:
            words[10:10] = ["zebrahouse", ENTITY]
        if key == 6:
            words[3] = "ZebraHouse"
        rows.append((key, " ".join(words)))
    return rows


@pytest.mark.parametrize("most", [0, 50_000])
def test_terms_that_disclose(docs_of, monkeypatch, most):
    monkeypatch.setattr(disclosure, "BROADCAST_TERMS", most)
    docs = docs_of(_rows())
    terms = {row["term"]: row["share"] for row in disclosing_terms(docs).collect()}
    # "reach" and "today" only ever stand there too; the random words have no support.
    assert terms.keys() == {"zebrahouse", "reach", "today"}
    found = {row["doc_id"]: row for row in personal_data(docs).collect()}
    for key, text in _rows():
        row, base = found[key], base_spans(text)
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert row["n_email"] == (key < 5) and row["n_terms"] == (3 if key < 5 else int(key == 6))
        if key < 7 and key != 5:
            assert "zebrahouse" not in row["sanitised"].lower() and "@example" not in row["sanitised"]
        else:
            assert row["sanitised"] == text


def test_copies_are_one_observation(docs_of):
    text = "only this passage has glimmerword by jo@example.org in it"
    assert disclosing_terms(docs_of([(key, text) for key in range(50)])).count() == 0


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_share_is_the_lower_bound(docs_of, monkeypatch, most):
    """Two distinct texts that agree tell of an address; one text, copies of it, common words do not."""
    monkeypatch.setattr(disclosure, "BROADCAST_COPIES", most)
    common = "these are the words that all of the texts have in them and no one would learn from".split()
    rows = [(key, " ".join([*common, "abcdefghij"[key // 10 % 10] * 4 + "abcdefghij"[key % 10] * 3])) for key in range(100)]
    once = " ".join(["Loneword", *common, "write al@example.org"])
    rows += [(key, once) for key in (200, 201, 202)]
    rows += [(300 + key, " ".join(["Quillfeather", *common, "x" * key, "mail jo@example.org"])) for key in (2, 3)]
    rows += [(302, rows[-1][1])]
    terms = {row["term"]: row["share"] for row in disclosing_terms(docs_of(rows)).collect()}
    # 103 distinct texts, two with both.  Wilson: 2 of 2, one deviation.
    lower = (1 + 1 / 4 - math.sqrt(1 / 16)) / (1 + 1 / 2)
    assert terms.keys() == {"quillfeather", "mail"}
    assert abs(terms["quillfeather"] - (lower - 2 / 103) / (1 - 2 / 103)) < 1e-9
    found = {row["doc_id"]: row for row in personal_data(docs_of(rows)).collect()}
    assert found[302]["n_terms"] == 2 and "Quillfeather" not in found[302]["sanitised"]
    assert found[200]["n_terms"] == found[5]["n_terms"] == 0 and found[200]["n_spans"] == 1


def test_lower_bounds(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (5.0, 5.0), (3.0, 4.0), (1.0, 100.0)], "k double, n double")
    found = [row[0] for row in rows.select(disclosure.lower_share(rows["k"], rows["n"])).collect()]
    assert [round(value, 3) for value in found] == [0.5, 0.667, 0.833, 0.5, 0.004]


def test_secrets():
    text = 'a token = "04dbebab91ab85687d33" b api_key: ABCDEFGH12345678 c note = aaaaaaaaaaaaaaaaaaaa1 token=short1'
    found = [text[a:b] for _, a, b in disclosure.secret_spans(text)]
    assert found == ["04dbebab91ab85687d33", "ABCDEFGH12345678"]
    # A base span inside a secret stays, and is not covered twice.
    base, more = disclosure.spans_of('x jo@example.org password="4111111111111111a"', {})
    assert [kind for kind, _, _ in base] == ["email", "card"] and more == []


def test_clean_documents_are_left_alone(spark):
    """Of the documents without personal data under 2 % get a span; those with it keep theirs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {row["doc_id"]: row["text"] or "" for row in docs.select("doc_id", "text").collect()}
    found = {row["doc_id"]: row for row in personal_data(docs).collect()}
    clean = [key for key, text in texts.items() if not disclosure.protected(text)]
    assert sum(found[key]["n_spans"] > 0 for key in clean) < 0.02 * len(clean)
    assert all(found[key]["n_spans"] > 0 for key in texts.keys() - set(clean))


@pytest.mark.parametrize("hashes", [0, 8_000_000])
def test_terms_too_many_to_send(docs_of, spark, monkeypatch, hashes):
    monkeypatch.setattr(disclosure, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(disclosure, "BROADCAST_HASHES", hashes)
    terms = spark.createDataFrame([("kept", 0.7), ("gone", 0.99)], "term string, share double")
    rows = disclosure.sanitise(docs_of([(1, "Kept and Gone, other words"), (2, "none")]), terms).collect()
    assert {row["doc_id"]: row["sanitised"] for row in rows} == {1: "<term> and , other words", 2: "none"}


def test_odd_rows_and_none(odd_docs):
    rows = personal_data(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(row["spans"] == "" for row in rows)
    assert personal_data(odd_docs.where("false")).count() == 0
