"""HTML entity decoding in one pass over the text, without a Python worker."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# What HTML counts as a character reference, and the last code
# point there is.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_HIGHEST = 0x10FFFF
_PAIR, _KEY = "\x1e", "\x1f"

# Names that also count without their semicolon, longest first so that the
# alternation picks the longest prefix.
_BARE = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
_BARE_PREFIX = f"\\A&({'|'.join(_BARE)})"


# Names per literal map.
_RANGE = 160


def _windows_1252(code: int) -> str:
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _lookup(table: dict[str, str]) -> Column:
    """A literal map; one string keeps the expression small, Spark folds it."""
    joined = _PAIR.join(f"{key}{_KEY}{value}" for key, value in table.items())
    return F.str_to_map(F.lit(joined), F.lit(_PAIR), F.lit(_KEY))


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numeric(reference: Column) -> Column:
    """Decode ``&#..;``, with the replacements HTML prescribes for bad numbers."""
    is_hex = F.lower(F.substring(reference, 3, 1)) == "x"
    digits = F.ltrim(
        F.regexp_extract(reference, r"\A&#[xX]?([0-9a-fA-F]+)", 1), F.lit("0")
    )
    # Eight digits are past the last code point in either base.
    small = F.when(F.length(digits) > 8, "99999999").when(digits == "", "0").otherwise(digits)
    code = F.when(is_hex, F.conv(small, 16, 10)).otherwise(small).cast("bigint")
    remapped = _lookup(
        {str(n): _windows_1252(n) for n in range(0x80, 0xA0)} | {"13": "\r"}
    )
    noncharacter = (
        code.between(0x01, 0x08)
        | (code == 0x0B)
        | code.between(0x0E, 0x1F)
        | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF)
        | code.bitwiseAND(F.lit(0xFFFE)).eqNullSafe(F.lit(0xFFFE))
    )
    return (
        F.when(
            (code == 0) | code.between(0xD800, 0xDFFF) | (code > _HIGHEST),
            "\N{REPLACEMENT CHARACTER}",
        )
        .when(
            code.between(0x80, 0x9F) | (code == 13),
            F.element_at(remapped, code.cast("string")),
        )
        .when(noncharacter, "")
        .otherwise(_character(code))
    )


def _named(reference: Column) -> Column:
    # A literal map is searched from its start: ranges of names keep each one short.
    name, names, whole = F.substr(reference, F.lit(2)), sorted(html5), None
    for high in range(len(names), 0, -_RANGE):
        some = names[max(0, high - _RANGE) : high]
        found = F.element_at(_lookup({key: html5[key] for key in some}), name)
        whole = found if whole is None else F.when(name <= some[-1], found).otherwise(whole)
    prefix = F.regexp_extract(reference, _BARE_PREFIX, 1)
    shortened = F.when(
        prefix != "",
        F.concat(
            F.element_at(_lookup({name: html5[name] for name in _BARE}), prefix),
            F.substr(reference, F.length(prefix) + F.lit(2)),
        ),
    )
    return F.coalesce(whole, shortened, reference)


def _decoded(reference: Column) -> Column:
    common = (
        F.when(reference == "&amp;", "&")
        .when(reference == "&lt;", "<")
        .when(reference == "&gt;", ">")
        .when(reference == "&quot;", '"')
    )
    return common.when(F.startswith(reference, F.lit("&#")), _numeric(reference)).otherwise(
        _named(reference)
    )


def unescape(text: Column) -> Column:
    """Decode every character reference once; ``&amp;lt;`` becomes ``&lt;``."""
    between = F.split(text, _REFERENCE, -1)
    decoded = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), 0), _decoded)
    joined = F.array_join(
        F.zip_with(
            between,
            F.concat(decoded, F.array(F.lit(""))),
            lambda piece, character: F.concat(piece, character),
        ),
        "",
    )
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)
