"""Licence notices in documents: Dice coefficient over word bigrams.

A unit and a template are normalised alike: lower case, runs of letters and digits
as words.  Their sets of neighbouring word pairs, A and B, have the coefficient
``2 |A & B| / (|A| + |B|)``.  For a threshold t it can only be reached if ``|A|`` lies
between ``t / (2 - t) |B|`` and ``(2 - t) / t |B|``, and only with ``t / (2 - t) |B|`` shared
pairs or more: a text with fewer pairs of a template is not searched for it.

A text's units are its lines, its paragraphs (runs of lines without a blank one),
itself, and windows: every run of words of up to ``(2 - t) / t |B|`` pairs, wherever it
begins and ends.  For each first pair that a template holds, the closest such
window counts.  Units that meet a template are taken by shared pairs, most first, then
by coefficient, and one that shares words with a unit already taken is left out,
so a sentence within a whole licence does not name another.

Templates are a parameter; the default is ``TEMPLATES``, short public notices, headers
and whole licence texts by SPDX id (files ``ID.txt`` and ``ID.variant.txt``), so what is
sent to the tasks does not grow with the data.

``n_matches`` counts lines, paragraphs and the text itself where they match, and taken
windows that lie in none of these.  Cases: a null or empty text has no unit and no
match; a unit of one word has no pair and matches nothing; a notice that is repeated
counts once per unit; of equal coefficients the first template by name wins; rows with
equal keys are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD_PERCENT = 80

# Fixed texts: short public notices, by licence.
NOTICES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License v3.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)

# Headers that files carry, and short forms; near versions are templates of their own.
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_FREE_2 = "This program is free software; you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version."
_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the {0} version {1} as published by the Free Software Foundation."
_TERMS = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
_GNU = (
    ("AGPL-3.0", "GNU Affero General Public License", "3"),
    ("GPL-2.0", "GNU General Public License", "2"),
    ("GPL-3.0", "GNU General Public License", "3"),
    ("LGPL-2.0", "GNU Library General Public License", "2"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3"),
)
HEADERS = (
    *((name, form.format(title, version)) for name, title, version in _GNU for form in (_FREE, _FREE_2, _ONLY, f"{_FREE} {_TERMS}", f"{_FREE_2} {_TERMS}")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "Licensed under the GNU General Public License v2.0."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License v2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License v3.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def _texts() -> Iterator[tuple[str, str]]:
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        yield re.sub(r"\.[a-z]+$", "", path.stem), path.read_text(encoding="utf-8")


TEMPLATES = (*NOTICES, *HEADERS, *_texts())

_WORD = re.compile(r"[^\W_]+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def pairs_of(text: str) -> frozenset[tuple[str, str]]:
    words = words_of(text)
    return frozenset(zip(words, words[1:]))


class Templates:
    """Templates by the size of their set; ``best`` compares only those in bounds."""

    def __init__(self, notices, percent: int = THRESHOLD_PERCENT):
        sets = [(len(pairs), name, pairs) for name, text in notices if (pairs := pairs_of(text))]
        self._sets = sorted(sets, key=lambda entry: entry[:2])
        self._sizes = [size for size, _, _ in self._sets]
        self._percent = percent
        self._known = frozenset().union(*(pairs for _, _, pairs in self._sets))
        # A unit with n pairs has 2 n + 1 characters or more.
        self._least_chars = 2 * (min(self._sizes, default=0) * percent // (200 - percent)) + 1

    def best(self, unit: str) -> tuple[int, int, str] | None:
        """Shared pairs, sum of both sizes, and the licence; ``None`` below the threshold."""
        if len(unit) < self._least_chars or not self._sets:
            return None
        p = self._percent
        pairs = pairs_of(unit)
        size = len(pairs)
        low, high = -(-p * size // (200 - p)), (200 - p) * size // p
        found = None
        for at in range(bisect_left(self._sizes, low), bisect_right(self._sizes, high)):
            other, name, wanted = self._sets[at]
            shared, total = len(pairs & wanted), size + other
            if 200 * shared >= p * total:
                lead = 1 if found is None else shared * found[1] - found[0] * total
                if lead > 0 or (lead == 0 and name < found[2]):
                    found = shared, total, name
        return found

    def possible(self, pairs: list[tuple[str, str]]) -> list[tuple[int, str, frozenset]]:
        """Templates of which a text with these pairs, or a part of it, can come near enough."""
        met = self._known.intersection(pairs)
        p, found = self._percent, []
        for entry in self._sets:
            least = -(-p * entry[0] // (200 - p))
            if least > len(met):
                break
            if len(met & entry[2]) >= least:
                found.append(entry)
        return found

    def windows(self, pairs: list[tuple[str, str]], possible) -> Iterator[tuple[int, int, int, int, str]]:
        """Per template and first pair the closest window: words from, to, shared pairs, sum of sizes, licence."""
        last: dict[tuple[str, str], int] = {}
        before = np.empty(len(pairs), np.int64)
        for at, pair in enumerate(pairs):
            before[at] = last.get(pair, -1)
            last[pair] = at
        p = self._percent
        for other, name, wanted in possible:
            inside = np.fromiter((pair in wanted for pair in pairs), bool, len(pairs))
            longest = (200 - p) * other // p
            so_far = np.concatenate(([0], np.cumsum(inside)))
            starts = np.flatnonzero(inside)
            ends = np.minimum(starts + longest, len(pairs))
            starts = starts[(so_far[ends] - so_far[starts]) * (200 - p) >= p * other]
            for start in starts.tolist():
                new = before[start : start + longest] < start
                shared = np.cumsum(new & inside[start : start + longest])
                total = np.cumsum(new) + other
                best = int(np.argmax(shared / total))
                if 200 * shared[best] >= p * total[best]:
                    yield start, start + best + 2, int(shared[best]), int(total[best]), name


def units(text: str) -> Iterator[tuple[int, str]]:
    """Lines, paragraphs and the text itself, each with the place of its first word."""
    lines = text.split("\n")
    paragraphs = _PARAGRAPH.split(text)
    for parts in (lines, paragraphs if len(paragraphs) > 1 else (), [text] if len(lines) > 1 else ()):
        at = 0
        for part in parts:
            yield at, part
            at += len(words_of(part))


def matches(text: str, templates: Templates) -> tuple[int, list[tuple[int, int, int, int, str]]]:
    """How many units match, and those taken: words from, to, shared pairs, sum of sizes, licence."""
    words = words_of(text)
    pairs = list(zip(words, words[1:]))
    possible = templates.possible(pairs)
    if not possible:
        return 0, []
    whole = [
        (at, at + len(words_of(unit)), *found) for at, unit in units(text) if (found := templates.best(unit))
    ]
    inside = np.zeros(len(words) + 1, np.int64)
    for low, high, *_ in whole:
        inside[low] += 1
        inside[high] -= 1
    outside = (np.cumsum(inside) == 0).tobytes()
    free, taken, count = bytearray(b"\1" * len(words)), [], len(whole)
    found = {*whole, *templates.windows(pairs, possible)}
    # The larger coefficient of equal numbers of shared pairs has the smaller sum.
    for unit in sorted(found, key=lambda unit: (-unit[2], unit[3], unit[4], unit[:2])):
        low, high = unit[:2]
        if free.find(0, low, high) < 0:
            free[low:high] = bytes(high - low)
            taken.append(unit)
            count += outside.find(1, low, high) >= 0
    return count, taken


RESULT = "doc_id bigint, n_matches bigint, licenses string, best_license string, best_dice double"


def license_scan(docs: DataFrame, notices=TEMPLATES, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Per row: matching units, the licences found, and the closest with its coefficient."""
    names = [part.split()[0] for part in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(notices, percent)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                count, taken = matches(text.as_py() or "", templates)
                licenses = {unit[4] for unit in taken}
                best = min(((-2 * unit[2] / unit[3], unit[4]) for unit in taken), default=(0.0, ""))
                out.append((key, count, ",".join(sorted(licenses)), best[1] or None, -best[0] or None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, RESULT)
