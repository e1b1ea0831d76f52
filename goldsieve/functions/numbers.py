"""Comparing answers: Python's float grammar and a relative tolerance."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldsieve.functions.text import strip

# Fixed value: relative and absolute tolerance of the comparison.
TOLERANCE = 1e-6

_INNER_UNDERSCORE = r"(?<=[0-9])_(?=[0-9])"
# Group 1 is what Spark can cast: the sign of a NaN stays outside.
_FLOAT = (
    r"\A(?:[-+](?=(?i:nan)\z))?("
    r"[-+]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|(?i:inf|infinity))"
    r"|(?i:nan))\z"
)


@cache
def _other_digits() -> tuple[str, str]:
    """Every decimal digit beyond ASCII, and the ASCII digit for each."""
    found = [
        chr(n)
        for n in range(0x80, sys.maxunicode + 1)
        if unicodedata.decimal(chr(n), None) is not None
    ]
    return "".join(found), "".join(str(unicodedata.decimal(ch)) for ch in found)


def to_double(value: Column) -> Column:
    """The number Python's ``float`` reads from ``value``, or null.

    A bare cast will not do: Spark takes ``1d`` and hexadecimal floats, and
    rejects ``1_000``.
    """
    digits = F.translate(strip(value), *_other_digits())
    plain = F.regexp_replace(digits, _INNER_UNDERSCORE, "")
    return F.regexp_extract(plain, _FLOAT, 1).try_cast("double")


def _near(left: Column, right: Column) -> Column:
    # Spark holds NaN equal to itself and above everything, hence the guards;
    # an infinite distance is never within reach.
    apart = F.abs(left - right)
    reach = F.lit(TOLERANCE) * F.greatest(F.abs(left), F.abs(right), F.lit(1.0))
    return ((left == right) & ~F.isnan(left)) | (
        (apart < F.lit(float("inf"))) & (apart <= reach)
    )


def is_close(left: Column, right: Column) -> Column:
    """Equal, or within tolerance; NaN is close to nothing; null if either is.

    The pair is bound to a lambda variable so that each side is computed once.
    """
    pair = F.array(F.struct(left.alias("left"), right.alias("right")))
    return F.get(F.transform(pair, lambda p: _near(p["left"], p["right"])), F.lit(0))


def normalize_answer(value: Column) -> Column:
    return F.replace(strip(value), F.lit(","), F.lit(""))


def comparable(value: Column) -> Column:
    """What a comparison needs of one answer: its text and its number, if any.

    Worked out per side, so before a join, it leaves little to do after it.
    """
    normal = normalize_answer(value)
    return F.struct(F.lower(normal).alias("text"), to_double(normal).alias("number"))


def same_answer(left: Column, right: Column) -> Column:
    """Compare two :func:`comparable` answers.

    Numerically close, or, unless both are numbers, equal ignoring case.
    """
    return F.coalesce(is_close(left["number"], right["number"]), left["text"] == right["text"])


def is_correct(gold: Column, predicted: Column) -> Column:
    """Whether an answer equals the gold, both being in the same row."""
    wanted, got = normalize_answer(gold), normalize_answer(predicted)
    # Same text is correct whatever it says, except NaN: most kept answers end
    # here, without being read as numbers.
    same = (wanted == got) & ~F.contains(F.lower(got), F.lit("nan"))
    return F.when(same, True).otherwise(same_answer(comparable(gold), comparable(predicted)))
