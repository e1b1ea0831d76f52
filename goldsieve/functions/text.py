"""Text clean-up as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldsieve.functions.entities import unescape
from goldsieve.functions.formats import FENCE, SPACE, SPACES


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Drop leading and trailing white space, counted as Python counts it."""
    return F.btrim(_col(value), F.lit(SPACES))


def strip_left(value: Column | str) -> Column:
    return F.ltrim(_col(value), F.lit(SPACES))


def strip_right(value: Column | str) -> Column:
    return F.rtrim(_col(value), F.lit(SPACES))


def normalize_text(value: Column | str) -> Column:
    """Line ends become LF, no-break and thin spaces become spaces, then strip."""
    lines = F.replace(_col(value), F.lit("\r\n"), F.lit("\n"))
    return strip(F.translate(lines, "\r\N{NO-BREAK SPACE}\N{THIN SPACE}", "\n  "))


# A fence line goes with the white space above it.  White space at a line start
# that leads to no fence is matched too and put back ($1), so that a long run of
# blank lines is gone through once, not once per line.
_FENCE_LINE = rf"(?md)^(?:{SPACE}*+{FENCE}[^\n]*|({SPACE}++))"


def drop_fences(value: Column | str) -> Column:
    text = _col(value)
    return F.when(
        F.contains(text, F.lit(FENCE)), F.regexp_replace(text, _FENCE_LINE, "$1")
    ).otherwise(text)


def clean_completion(value: Column | str) -> Column:
    """Entities decoded, fence lines removed, stripped; null becomes empty."""
    unescaped = F.array(unescape(_col(value)))
    stripped = F.get(F.transform(unescaped, lambda text: strip(drop_fences(text))), F.lit(0))
    return F.coalesce(stripped, F.lit(""))
