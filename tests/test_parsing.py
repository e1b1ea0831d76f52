"""The two parsers, on cases where they agree and where they must not."""

import random

import pytest

from goldsieve.operators.parsing import parse_lenient, parse_strict

R, A, E = "<trip_before>r</trip_before>", "<answer>1</answer>", "<end>e</end>"
WHOLE = ("r", "1", "e")


def _parse(spark, parser, values):
    df = spark.createDataFrame(list(enumerate(values)), "n int, text string")
    rows = parser(df).orderBy("n").collect()
    return [tuple(row.parsed) if row.parsed else None for row in rows]


CASES = [
    # text, strict, lenient
    (f"{R}\n{A}\n{E}", WHOLE, WHOLE),
    (f" \n{R}{A}{E} ", WHOLE, WHOLE),
    (f"{R}{A}<end>e", WHOLE, WHOLE),
    (f"{R}{A}<end> e \nmore", ("r", "1", "e \nmore"), ("r", "1", "e \nmore")),
    (f"{R}{A}{E}bye", WHOLE, ("r", "1", "e</end>bye")),
    (f"Sure: {R}{A}{E}", None, WHOLE),
    (f"{A}{R}{E}", None, WHOLE),
    (f"{R}{A}{E}".upper(), None, ("R", "1", "E")),
    (f"{R}{A}{E}".replace("<", "&lt;").replace(">", "&gt;"), None, WHOLE),
    (f"```xml\n{R}\n{A}\n{E}\n```", None, WHOLE),
    (f"{R}<answer></answer>{E}", None, ("r", "", "e")),
    (f"{R}<answer>  </answer>{E}", ("r", "", "e"), ("r", "", "e")),
    (f"{R}{A}", None, None),
    (f"{R}{E}", None, None),
    (f"{R}{A}<end></end>", None, ("r", "1", "")),
    (f"{R} x {R}{A}{E}", ("r</trip_before> x <trip_before>r", "1", "e"), WHOLE),
    (f"{R}{A}{E}\x01", WHOLE, ("r", "1", "e</end>\x01")),
    (f"{R.replace('r<', chr(1) + '<')}{A}{E}", ("\x01", "1", "e"), ("\x01", "1", "e")),
    ("", None, None),
    (None, None, None),
]


@pytest.mark.parametrize("parser, column", [(parse_strict, 1), (parse_lenient, 2)])
def test_known_cases(spark, parser, column):
    found = _parse(spark, parser, [case[0] for case in CASES])
    assert found == [case[column] for case in CASES]


TAGS = [("<trip_before>", "</trip_before>"), ("<answer>", "</answer>"), ("<end>", "</end>")]


def _blocks(text, at, tags):
    """All blocks from ``at``, trying shorter content first and blank content last."""
    if not tags:
        return []
    (opening, closing), rest = tags[0], tags[1:]
    while at < len(text) and text[at].isspace():
        at += 1
    if not text.startswith(opening, at):
        return None
    start = at + len(opening)
    first = start
    while first < len(text) and text[first].isspace():
        first += 1
    stops = []
    stop = text.find(closing, first + 1)
    while stop >= 0:
        stops.append((first, stop))
        stop = text.find(closing, stop + 1)
    if first > start and text.startswith(closing, first):
        stops.append((start, first))
    for begin, stop in stops:
        following = _blocks(text, stop + len(closing), rest)
        if following is not None:
            return [text[begin:stop].strip(), *following]
    return None


def test_strict_against_brute_force(spark):
    pick = random.Random(7)
    pieces = [tag for pair in TAGS for tag in pair] + [" ", "\n", "x", "1", "\x01"]
    values = []
    for _ in range(4000):
        tokens = ["<trip_before>", "r", "</trip_before>", "<answer>", "1", "</answer>"]
        tokens += ["<end>", "e", "</end>"]
        for _ in range(pick.randint(0, 5)):
            at = pick.randrange(len(tokens))
            if pick.random() < 0.6:
                tokens.insert(at, pick.choice(pieces))
            else:
                tokens[at] = pick.choice(["", " ", pick.choice(pieces)])
        values.append("".join(tokens))

    def expected(text):
        text = text.strip(" \t\n\r\f\v")
        if "<end>" in text and "</end>" not in text:
            text += "</end>"
        found = _blocks(text, 0, TAGS)
        return tuple(found) if found else None

    assert _parse(spark, parse_strict, values) == [expected(value) for value in values]


def test_long_white_space_stays_fast(spark):
    blank = " " * 100_000
    text = f"<trip_before>{blank}x{blank}y</trip_before>{blank}<answer>{blank}"
    assert _parse(spark, parse_strict, [text]) == [None]
    assert _parse(spark, parse_lenient, [text]) == [None]
