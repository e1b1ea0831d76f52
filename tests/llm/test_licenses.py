import random
import re
from fractions import Fraction

from goldsieve.llm.licenses import NOTICES, TEMPLATES, Templates, license_scan, matches


def _pairs(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return {(a, b) for a, b in zip(words, words[1:])}


def _best(unit, percent):
    found = []
    for name, text in NOTICES:
        a, b = _pairs(unit), _pairs(text)
        if a and b and (dice := Fraction(2 * len(a & b), len(a) + len(b))) * 100 >= percent:
            found.append((-dice, name))
    return min(found, default=None)


def test_bounds_lose_nothing():
    rng = random.Random(1)
    for percent in (30, 80, 100):
        templates = Templates(NOTICES, percent)
        for _ in range(2000):
            words = rng.choice(NOTICES)[1].split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(["x", "License", "the", ""])
            unit = " ".join(words[rng.randint(0, 2) :] + ["more"] * rng.randint(0, 3))
            got, wanted = templates.best(unit), _best(unit, percent)
            assert (got and (-Fraction(2 * got[0], got[1]), got[2])) == wanted


def test_documents(docs_of):
    mit = next(text for name, text in NOTICES if name == "MIT" and len(text) > 60)
    rows = [
        (1, "prose\nLicensed under the APACHE licence, version 2.0\nLicensed under the Apache License, Version 2.0."),
        (2, "intro\n\n" + mit.replace(", ", ",\n") + "\n\nprose " * 30),
        (3, "the license of this text is a matter of prose"),
        (4, "Released under the MIT License.\n" * 3),
    ]
    found = {row["doc_id"]: tuple(row)[1:] for row in license_scan(docs_of(rows)).collect()}
    assert found[1][2:] == ("Apache-2.0", 1.0) and found[2][1] == "MIT" and found[2][3] > 0.99
    assert found[3] == (0, "", None, None) and found[4][:2] == (4, "MIT")


def test_odd_rows_and_none(odd_docs):
    rows = license_scan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(row["n_matches"] for row in rows)
    assert license_scan(odd_docs.where("false")).count() == 0


def test_notices_inside_longer_units(docs_of):
    mit = next(text for name, text in TEMPLATES if name == "MIT" and "NONINFRINGEMENT" in text)
    header = next(text for name, text in TEMPLATES if name == "Apache-2.0" and "governing" in text).split()
    lines = "\n".join(" * " + " ".join(header[at : at + 8]) for at in range(0, len(header), 8))
    rows = [
        (1, "Some words of prose here. Released under the MIT License. All the rest follows in this line."),
        (2, "/*\n * Copyright (c) 2001 some body\n *\n" + lines + "\n *\n * A module that reads and writes\n */\nimport os"),
        (3, "prose " * 40 + mit + " prose" * 40),
        (4, "prose " * 9 + "Released under the MIT License. Licensed under CC BY 4.0. " + "more " * 9),
        (5, "prose " * 9 + mit.rpartition("THE SOFTWARE IS")[0] + "end " * 9),
    ]
    found = {row["doc_id"]: tuple(row)[1:] for row in license_scan(docs_of(rows)).collect()}
    assert found[1] == (1, "MIT", "MIT", 1.0) and found[3][1:] == ("MIT", "MIT", 1.0)
    assert found[2][1:3] == ("Apache-2.0", "Apache-2.0") and found[2][3] > 0.95
    assert found[4] == (2, "CC-BY-4.0,MIT", "CC-BY-4.0", 1.0) and found[5][1] == "MIT"


def test_each_template_names_its_licence():
    templates = Templates(TEMPLATES)
    for name, text in TEMPLATES:
        _, taken = matches(f"before it {text} after it", templates)
        assert name in {unit[4] for unit in taken}, (name, text[:60])
    bsd = next(text for name, text in TEMPLATES if name == "BSD-2-Clause" and len(text) > 200)
    assert {unit[4] for unit in matches("prose before it\n" + bsd, templates)[1]} == {"BSD-2-Clause"}


def test_windows_are_the_closest_runs():
    rng = random.Random(3)
    for percent in (60, 80):
        templates = Templates(NOTICES, percent)
        for _ in range(60):
            words = re.findall(r"[^\W_]+", rng.choice(NOTICES[:4])[1].lower())
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(["x", "license", "the", "y"])
            words = ["a", "b"] + words + ["c", "the"]
            pairs = list(zip(words, words[1:]))
            got = {(unit[0], unit[4]): 0.0 for unit in templates.windows(pairs, templates.possible(pairs))}
            for start, _, shared, total, name in templates.windows(pairs, templates.possible(pairs)):
                got[start, name] = max(got[start, name], shared / total)
            wanted = {}
            for name, text in NOTICES:
                b = _pairs(text)
                for start in range(len(pairs)):
                    for end in range(start + 1, len(pairs) + 1):
                        a = set(pairs[start:end])
                        if pairs[start] in b and end - start <= (200 - percent) * len(b) // percent and 200 * len(a & b) >= percent * (len(a) + len(b)):
                            wanted[start, name] = max(wanted.get((start, name), 0), len(a & b) / (len(a) + len(b)))
            assert got == wanted
