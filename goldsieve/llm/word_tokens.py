"""Encoding of whole texts with a public tokenizer, one cached word at a time.

The tokenizer drops white space and never merges across it, so a text's ids
are its words' ids in order.  Distinct words are far fewer than words, and a
word of Latin letters needs only the model itself: its normalised form is its
lower case, and its one piece is all its letters.  Every other word goes
through the whole tokenizer.
"""

from __future__ import annotations

from array import array

from tokenizers import Tokenizer

# The byte-level alphabet maps printable bytes to themselves and
# the others, in order, to the code points from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [byte for byte in range(256) if byte not in _PRINTABLE]
_BYTES = {byte: byte if byte in _PRINTABLE else 256 + _OTHERS.index(byte) for byte in range(256)}

_MARKS = ".,!?;:|*#$%&"
_CACHED = 250_000


def _ids(values: list[int]) -> bytes:
    return array("I", values).tobytes()


class WordEncoder:
    """``encode(text)`` gives all ids of a text as little-endian u32 bytes.

    Both caches are emptied when they hold ``_CACHED`` words: memory stays
    bounded on any corpus and only speed depends on it.
    """

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self.vocabulary = self._tokenizer.get_vocab_size()
        self._words: dict[str, bytes] = {"": b""}
        self._cores: dict[str, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return _ids(self._tokenizer.encode(word, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        low = core.lower()
        if not low.isalpha():
            return self._whole(word)
        found = self._cores.get(low)
        if not core.isascii():
            # Letters below U+0250 are composed already, with simple lower cases.
            if max(low) >= "\u0250" or max(core) >= "\u0250":
                return self._whole(word)
            mapped = low.encode().decode("latin-1").translate(_BYTES)
        else:
            mapped = low
        if found is None:
            if len(self._cores) >= _CACHED:
                self._cores.clear()
            found = self._cores[low] = _ids([t.id for t in self._model.tokenize(mapped)])
        if len(core) == len(word):
            return found
        rest = word[len(core) :]
        marks = self._words.get(rest)
        if marks is None:
            marks = self._words[rest] = self._whole(rest)
        return found + marks

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        cache = self._words
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:
            if len(cache) >= _CACHED:
                cache.clear()
                cache[""] = b""
            encode = self._word
            for word in words:
                if word not in cache:
                    cache[word] = encode(word)
            return b"".join(map(cache.__getitem__, words))
