"""Markers, tags and patterns that define the completion format."""

# Markers and tags of the exchanged text.
GOLD_MARKER = "####"
REASON_OPEN, REASON_CLOSE = "<trip_before>", "</trip_before>"
ANSWER_OPEN, ANSWER_CLOSE = "<answer>", "</answer>"
CLOSING_OPEN, CLOSING_CLOSE = "<end>", "</end>"
FENCE = "```"

# The code points Python counts as white space.
SPACES = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)

# The same set as Java character classes: Java's own \s leaves some of them out.
_WIDE_SPACES = r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACE_SET = r"\x09-\x0D\x1C-\x20\x85\xA0" + _WIDE_SPACES
SPACE = f"[{_SPACE_SET}]"
NOT_SPACE = f"[^{_SPACE_SET}]"

# A number token and the phrases that announce an answer.
NUMBER = r"[-+]?\p{Nd}+(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?"
ANNOUNCED = rf"[Tt]he answer is[:{_SPACE_SET}]*({NUMBER})"
LABELLED = rf"[Aa]nswer[:{_SPACE_SET}]*({NUMBER})"
# A number that ends the text, with an optional full stop.  Starting inside a
# run of digits can never be the leftmost match: the look-behind only saves the
# retries that would make long digit runs quadratic.
TRAILING = (
    r"(?=[-+\p{Nd}])((?:[-+]|(?<!\p{Nd}))\p{Nd}++(?:,\p{Nd}{3})*+(?:\.\p{Nd}++)?+)"
    rf"{SPACE}*+\.?(?=\n?\z)"
)
