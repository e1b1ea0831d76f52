"""The two completion parsers, and the clean-up in front of the lenient one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldsieve.functions.formats import (
    ANSWER_CLOSE,
    ANSWER_OPEN,
    CLOSING_CLOSE,
    CLOSING_OPEN,
    NOT_SPACE,
    REASON_CLOSE,
    REASON_OPEN,
    SPACE,
)
from goldsieve.functions.text import clean_completion, strip


def _block(opening: str, closing: str) -> str:
    """One non-empty block of the strict format; group 1 is its content.

    Content that is not all white space is tried first, so an all-blank block
    is taken only where nothing longer fits.  The possessive runs of white
    space keep the match linear in them.
    """
    return rf"{opening}(?:{SPACE}*+({NOT_SPACE}.*?)|{SPACE}++){closing}"


_STRICT = (
    rf"(?s)\A{SPACE}*+{_block(REASON_OPEN, REASON_CLOSE)}"
    rf"{SPACE}*+{_block(ANSWER_OPEN, ANSWER_CLOSE)}"
    rf"{SPACE}*+{_block(CLOSING_OPEN, CLOSING_CLOSE)}"
)
# Puts the three groups into one string, so a text is matched once, not three
# times.  Texts that hold the separator themselves take the other branch.
_SEPARATOR = "\x01"
_GROUPS = _SEPARATOR.join(("$1", "$2", "$3"))


def _parsed(reason: Column, answer: Column, closing: Column) -> Column:
    return F.struct(
        reason.alias("reason"), answer.alias("answer"), closing.alias("closing")
    )


def parse_strict(df: DataFrame, text: str = "text", into: str = "parsed") -> DataFrame:
    """Add the struct ``reason, answer, closing``, or null.

    The three blocks must open the text, in order, in lower case, with only
    white space between them; anything may follow.  A missing last closing tag
    is supplied if the text has none anywhere, after white space at its end is
    dropped: a closing block that was never written stays empty and fails.
    """
    value = strip(text)
    closed = F.when(F.contains(value, F.lit(CLOSING_CLOSE)), value).when(
        F.contains(value, F.lit(CLOSING_OPEN)), F.concat(value, F.lit(CLOSING_CLOSE))
    )
    target = F.col("_closed")
    at_once = F.split(F.regexp_replace(target, _STRICT + r".*\z", _GROUPS), _SEPARATOR, -1)
    one_by_one = F.when(
        F.rlike(target, F.lit(_STRICT)),
        F.array(*(F.regexp_extract(target, _STRICT, group) for group in (1, 2, 3))),
    )
    blocks = F.when(F.contains(target, F.lit(_SEPARATOR)), one_by_one).otherwise(at_once)
    found = F.col("_blocks")
    return (
        df.withColumn("_closed", closed)
        .withColumn("_blocks", blocks)
        .withColumn(
            into,
            F.when(
                F.size(found) == 3, _parsed(*(strip(F.get(found, F.lit(n))) for n in range(3)))
            ),
        )
        .drop("_closed", "_blocks")
    )


def clean_completions(df: DataFrame, text: str = "text", into: str = "cleaned") -> DataFrame:
    """Add the text with entities decoded and fence lines removed."""
    return df.withColumn(into, clean_completion(text))


def _inside(block: Column, opening: str, closing: str) -> Column:
    return strip(
        F.substr(
            block,
            F.lit(len(opening) + 1),
            F.length(block) - F.lit(len(opening) + len(closing)),
        )
    )


def parse_lenient(df: DataFrame, text: str = "text", into: str = "parsed") -> DataFrame:
    """Add the struct ``reason, answer, closing``, or null, from cleaned text.

    The first block of each kind counts, in any order and letter case.  The
    closing block runs to the end of the text, less one closing tag there; a
    closing tag further up is part of it.
    """
    cleaned = F.col("_cleaned")
    reason, answer, closing = F.col("_reason"), F.col("_answer"), F.col("_closing")
    tail = strip(F.substr(closing, F.lit(len(CLOSING_OPEN) + 1)))
    return (
        df.withColumn("_cleaned", clean_completion(text))
        .withColumn(
            "_reason",
            F.regexp_extract(cleaned, rf"(?siu){REASON_OPEN}.*?{REASON_CLOSE}", 0),
        )
        .withColumn(
            "_answer",
            F.regexp_extract(cleaned, rf"(?siu){ANSWER_OPEN}.*?{ANSWER_CLOSE}", 0),
        )
        .withColumn("_closing", F.regexp_extract(cleaned, rf"(?siu){CLOSING_OPEN}.*\z", 0))
        .withColumn(
            into,
            F.when(
                (reason != "") & (answer != "") & (closing != ""),
                _parsed(
                    _inside(reason, REASON_OPEN, REASON_CLOSE),
                    _inside(answer, ANSWER_OPEN, ANSWER_CLOSE),
                    strip(F.regexp_replace(tail, rf"(?iu){CLOSING_CLOSE}\z", "")),
                ),
            ),
        )
        .drop("_cleaned", "_reason", "_answer", "_closing")
    )
