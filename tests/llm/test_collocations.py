import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from goldsieve.llm import collocations as mined
from goldsieve.llm.collocations import _Codes, collocations, merge_join, occurrences

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _brute(rows, least, longest, top):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for width in range(1, longest + 1):
                counts[lang].update(tuple(words[at : at + width]) for at in range(len(words) - width + 1))
    out = []
    for lang, f in counts.items():
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        above = Counter()
        for p, a in wanted.items():
            for width in range(2, len(p)):
                for at in range(len(p) - width + 1):
                    above[p[at : at + width]] = max(above[p[at : at + width]], a)
        found = []
        for p, a in wanted.items():
            if 100 * above[p] >= 50 * a:
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def _docs(spark, rows):
    full = [(n, text, lang, "s", 0) for n, (text, lang) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


def _check(spark, rows, least=10, longest=3, top=2000):
    got = collocations(_docs(spark, rows), least, longest, top).collect()
    wanted = _brute(rows, least, longest, top)
    assert sorted(map(tuple, got)) == sorted(wanted)
    return wanted


def test_occurrences_and_merge_join():
    codes = _Codes()
    places = np.concatenate(occurrences("A b\tB. a  B\x0bb a".encode(), codes))
    assert list(codes)[2:] == [b"a", b"b"]
    assert places.tolist() == [1, 2, 2, 0, 1, 2, 0, 2, 1, 0]
    pairs = merge_join(places, places, 2)
    assert [(key >> 32, key & 3) for key in pairs.tolist()] == [(1, 2), (2, 2), (0, 0), (0, 0), (1, 2), (0, 0), (0, 0), (2, 1), (0, 0), (0, 0)]
    numbers = np.where(pairs > 0, np.arange(1, 11), 0).astype(np.int32)
    assert [(at, key >> 32, key & 3) for at, key in enumerate(merge_join(places, numbers, 3).tolist()) if key] == [(0, 1, 2)]
    assert merge_join(places[:1], places[:1], 3).tolist() == [0]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_random_texts(spark, longest):
    rng = random.Random(longest)
    words = ["a", "B", "cc", "Dä", "É", "e-f", " g"] + [f"r{n}" for n in range(30)]
    rows = []
    for _ in range(150):
        text = "".join(rng.choice(words[: rng.choice([3, 7, 37])]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "en", "de", "und", None, ""])))
    _check(spark, rows, longest=longest)
    wanted = _check(spark, rows, least=2, longest=longest)
    assert max(len(row[2].split(" ")) for row in wanted) == longest
    _check(spark, rows, least=3, longest=longest, top=20)


def test_one_phrase_in_a_third_of_all_rows(spark):
    rows = [("the hot phrase", "en")] * 100 + [(f"w{n % 20} w{n % 7} x", "en") for n in range(200)]
    _check(spark, rows)


def test_odd_rows_none_and_clashing_columns(spark, odd_docs):
    rows = [(row["text"], row["lang"]) for row in odd_docs.collect()]
    got = collocations(odd_docs)
    assert sorted(map(tuple, got.collect())) == sorted(_brute(rows, 10, 3, 2000))
    assert collocations(odd_docs.where("false")).count() == 0
    more = odd_docs.selectExpr("*", "1 AS ids", "2 AS phrase", "3 AS block", "4 AS n", "5 AS key")
    assert sorted(map(tuple, collocations(more).collect())) == sorted(map(tuple, got.collect()))


def test_products_beyond_64_bits(spark):
    one = spark.range(1).selectExpr("30000000000001L AS a", "30000000000002L AS l", "30000000000003L AS r")
    a, left, right = 30000000000001, 30000000000002, 30000000000003
    assert one.select(mined.score(one["a"], one["l"], one["r"])).first()[0] == 10**6 * a * a // (left * right)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_blocks_of_many_short_rows(spark, monkeypatch, longest):
    """No row holds more than a part, phrases across its border count, and no row grows with a block."""
    monkeypatch.setattr(mined, "PART_PLACES", 7)
    rng = random.Random(8)
    rows = [(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 50))) + rng.choice(["", ". c d"]), rng.choice(["en", "de"])) for _ in range(40)]
    wanted = _check(spark, rows, least=3, longest=longest)
    assert max(len(row[2].split(" ")) for row in wanted) == longest
    relation = mined._first_relation(_docs(spark, rows))
    assert 0 < relation.selectExpr("max(length(rk))").first()[0] <= 7 * 4


def test_parts_of_a_block_in_two_tasks(spark, monkeypatch):
    """Two tasks that share a block's parts give a phrase two rows, and the same result."""
    monkeypatch.setattr(mined, "PART_PLACES", 7)
    write = mined.Scratch.write
    monkeypatch.setattr(mined.Scratch, "write", lambda self, df, what: write(self, df.repartition(5) if what in ("r1", "r") else df, what))
    rng = random.Random(9)
    rows = [(" ".join(rng.choice("abcd") for _ in range(30)), "en") for _ in range(40)]
    for longest in (3, 4):
        _check(spark, rows, least=3, longest=longest)
