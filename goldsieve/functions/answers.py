"""Pulling gold and predicted answers out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldsieve.functions.formats import (
    ANNOUNCED,
    ANSWER_CLOSE,
    ANSWER_OPEN,
    GOLD_MARKER,
    LABELLED,
    NUMBER,
    SPACES,
    TRAILING,
)
from goldsieve.functions.text import strip, strip_left, strip_right


def _without_commas(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit(""))


def _last_match(text: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), group), F.lit(-1))


def final_answer(solution: Column) -> Column:
    """Gold answer of a normalised solution; null when it has no marker.

    Everything after the first marker counts; a number in it wins over the text.
    """
    at = F.instr(solution, GOLD_MARKER)
    tail = strip(F.substr(solution, at + F.lit(len(GOLD_MARKER))))
    number = F.regexp_extract(tail, NUMBER, 0)
    return F.when(
        at > 0, F.when(number != "", _without_commas(number)).otherwise(tail)
    )


def rationale(solution: Column, answer: Column) -> Column:
    """A normalised solution without its answer line.

    A last line that begins with the marker goes whole.  Otherwise the text
    loses a closing ``#### answer``, spelled as ``answer`` is: without commas.
    """
    last_line = F.substring_index(solution, "\n", -1)
    above = F.left(solution, F.length(solution) - F.length(last_line) - F.lit(1))
    before = strip_right(F.left(solution, F.length(solution) - F.length(answer)))
    inline = F.endswith(solution, answer) & F.endswith(before, F.lit(GOLD_MARKER))
    return strip(
        F.when(F.startswith(strip_left(last_line), F.lit(GOLD_MARKER)), above)
        .when(inline, F.left(before, F.length(before) - F.lit(len(GOLD_MARKER))))
        .otherwise(solution)
    )


def after_last_marker(solution: Column) -> Column:
    """Text behind the last marker, or all of it when there is none."""
    return strip(F.element_at(F.split(solution, GOLD_MARKER, -1), -1))


def cut_at_answer(text: Column) -> Column:
    """Text up to and with the first closing answer tag."""
    close = F.locate(ANSWER_CLOSE, text)
    return F.when(
        close > 0, F.substr(text, F.lit(1), close + F.lit(len(ANSWER_CLOSE) - 1))
    ).otherwise(text)


def normalize_vote(value: Column) -> Column:
    """No commas, dollars, white space or trailing full stops."""
    return F.rtrim(F.translate(value, ",$" + SPACES, ""), F.lit("."))


def tagged_answer(text: Column) -> Column:
    """Answer of a completion read up to its first closing answer tag.

    The tag body if there is one (it may be empty), else the last number, else
    null.  Before the first closing tag there is no other one, so the body is
    all that follows the first opening tag there.
    """
    head = F.substring_index(text, ANSWER_CLOSE, 1)
    body = F.substr(head, F.locate(ANSWER_OPEN, head) + F.lit(len(ANSWER_OPEN)))
    tagged = F.contains(text, F.lit(ANSWER_CLOSE)) & F.contains(head, F.lit(ANSWER_OPEN))
    return normalize_vote(F.when(tagged, body).otherwise(_last_match(head, NUMBER, 0)))


def phrased_answer(text: Column) -> Column:
    """Answer announced in a phrase, else labelled, else ending the text."""
    # Cheap and necessary: what is left of trailing spaces and stops is a digit.
    end = F.right(F.rtrim(text, F.lit("." + SPACES)), F.lit(1))
    ends_in_digit = F.rlike(end, F.lit(r"\p{Nd}"))
    return _without_commas(
        F.coalesce(
            _last_match(text, ANNOUNCED, 1),
            _last_match(text, LABELLED, 1),
            F.when(ends_in_digit, _last_match(text, TRAILING, 1)),
        )
    )

