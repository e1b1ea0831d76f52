"""Text expressions against the standard library and brute force."""

import html
import random


from goldsieve.functions.entities import unescape
from goldsieve.functions.formats import SPACES
from goldsieve.functions.text import clean_completion, drop_fences, normalize_text, strip


def _mixed(pieces, count, longest, seed):
    pick = random.Random(seed)
    return [
        "".join(pick.choice(pieces) for _ in range(pick.randint(1, longest)))
        for _ in range(count)
    ]


def test_spaces_are_those_of_python():
    assert set(SPACES) == {chr(n) for n in range(0x110000) if chr(n).isspace()}


def test_strip_is_python_strip(texts):
    values = _mixed(list(SPACES) + ["x", "\N{ZERO WIDTH SPACE}", "\N{GRINNING FACE}"], 500, 6, 1)
    assert texts(values, strip) == [value.strip() for value in values]


def test_unescape_is_single_pass_html(texts):
    pieces = """&amp; &amp &lt; &gt &quot; &notit; &not &#65; &#x41 &#x80; &#150; &#0; &#13;
        &#1; &#xD800; &#x110000; &#99999999999999; &#x000000041; &Tab; &NewLine;
        &NotEqualTilde; &bogus; &; &#; &#x; &frac12 &AMP &lta &acE; &#xFFFE; &#x1FFFF; &#11;
        &#128512; &hearts; &ampamp; &#xfdd0; & # a amp; lt;""".split()
    values = _mixed([*pieces, " ", "\n", "&" + "a" * 40 + ";"], 1500, 6, 2)
    assert texts(values, unescape) == [html.unescape(value) for value in values]
    assert texts(["&amp;lt;", None], unescape) == ["&lt;", None]


def _fence_free(text):
    """Drop each fence with the white space that leads to it from a line start."""
    out, at = [], 0
    while at < len(text):
        if at == 0 or text[at - 1] == "\n":
            end = at
            while end < len(text) and text[end].isspace():
                end += 1
            if text.startswith("```", end):
                stop = text.find("\n", end)
                at = len(text) if stop < 0 else stop
                continue
        out.append(text[at])
        at += 1
    return "".join(out)


def test_fences_go_with_blank_lines_above(texts):
    pieces = ["```", "```py", "\n", "\n\n", "  ", "\t", "x", "\x0b", "\r", "\N{NO-BREAK SPACE}"]
    values = _mixed(pieces, 2000, 9, 3)
    assert texts(values, drop_fences) == [_fence_free(value) for value in values]


def test_long_blank_runs_stay_fast(texts):
    text = "```\n" + "\n " * 100_000 + "x"
    assert texts([text], clean_completion) == ["x"]


def test_clean_completion(texts):
    values = ["```xml\n&lt;answer&gt;1\n```\n", "  a  ", "", None]
    assert texts(values, clean_completion) == ["<answer>1", "a", "", ""]


def test_normalize_text(texts):
    odd = " a\r\nb\rc\N{NO-BREAK SPACE}d\N{THIN SPACE}e\n"
    assert texts([odd, "\x1ca\x85", None], normalize_text) == ["a\nb\nc d e", "a", None]
