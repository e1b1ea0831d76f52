"""Personal data, and terms that disclose it by what they occur next to.

Base spans are the patterns for e-mail addresses, internet addresses, card and
phone numbers.  Each distinct value found is a protected entity.  A term is a run
of letters, lower-cased.  Corpus co-occurrence says how much a term gives away of an entity.  With texts as events,
P(e | t) is the share of the texts with the term that hold the entity; what is judged is not the
share seen but the lower end of its confidence interval (Wilson's, ``Z`` deviations), less
the entity's base rate:

    share = (lower(both, texts with t) - P(e)) / (1 - P(e)).

A term of one text stays below one half, however rare it is: rare words are common, and
a text with an entity has as many as any other.  Two texts that agree, and no third,
come to two thirds, and five to five sixths.  An entity that is in every text is revealed
by none.  Terms whose share reaches ``GENERALISE`` are replaced by a category; at
``REMOVE`` they go.  A term is thus found mostly where its entity is: more than half of
its texts hold it.

Events are distinct texts: copies of one, told by a 64-bit hash, count once.  All terms
of a text with an entity count, wherever they stand outside personal data.

Secrets, values of 16 characters or more with letters and digits that a name such as
``token`` or ``password`` is given, are protected entities as well, and spans of their own.

The corpus counts read all documents.  Terms are counted per task and number of copies of
their text before they are shuffled, so a text's copies add up to one without meeting.
Only texts with an entity are sent as rows of terms, and only entities of two texts or
more are paired with them.  The hashes of texts with copies are sent to the tasks if there
are ``BROADCAST_COPIES`` or fewer, which is counted; otherwise they meet in a join.  The
terms found are sent to the tasks as they are if there are ``BROADCAST_TERMS`` or fewer, as
64-bit hashes if ``BROADCAST_HASHES`` or fewer; beyond that each text meets its own terms
in a join.

Cases: a null text is an empty one and has no spans; values repeated in a text
give a span each; rows with equal keys are searched one by one; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldsieve.durable import written
from goldsieve.llm.shuffles import bounded_batches, release_shuffles

KINDS = ("email", "ip", "card", "phone")
Z = 1.0
GENERALISE = 0.5
REMOVE = 0.8
BROADCAST_TERMS = 50_000
BROADCAST_COPIES = 1_000_000
BROADCAST_HASHES = 2_000_000
_FLUSH = 200_000

# Fixed patterns of the base spans.  A run that an e-mail address's local part or
# a number starts in can only match from its first character, so the scans start
# there and stay linear on runs of any length.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = str.maketrans("", "", " -().+")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TERM = re.compile(r"[^\W\d_]+")
_VALUE = re.compile(r"[=:][\x20\t]{0,3}[\"']?([A-Za-z0-9_+/-]{16,})")
_NAME = re.compile(r"(?i:token|secret|api[_-]?key|passwo?r?d)[\"']?[\x20\t]{0,3}\Z")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield "email", start, done
        else:
            # Nothing before this sign can be part of a later match.
            done = at + 1
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans by kind as in ``KINDS``, then by start; code points, end exclusive."""
    found = list(_emails(text)) if "@" in text else []
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in match[0].split(".")):
            found.append(("ip", *match.span()))
    for match in _CARD.finditer(text):
        digits = match[0].translate(_DIGITS)
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *match.span()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= len(match[0].translate(_DIGITS)) <= 15:
                found.append(("phone", *match.span()))
    return found


def secret_spans(text: str) -> list[Span]:
    """Values that stand after the name of a secret."""
    found = []
    for match in _VALUE.finditer(text):
        value = match[1]
        if _NAME.search(text, max(0, match.start() - 16), match.start()) and any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
            found.append(("secret", *match.span(1)))
    return found


def protected(text: str) -> list[Span]:
    return base_spans(text) + secret_spans(text)


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else value.translate(_DIGITS) if kind != 'ip' else value}"


def _terms(text: str) -> list[str]:
    return [term for term in map(str.lower, _TERM.findall(text)) if len(term) > 1]


def _terms_outside(text: str, spans: list[Span]) -> set[str]:
    """Terms of a text; personal data is not read as terms."""
    pieces, at = [], 0
    for _, start, end in sorted(spans, key=lambda span: span[1]):
        pieces.append(text[at:start])
        at = max(at, end)
    return set(_terms(" ".join((*pieces, text[at:]))))


def _rows(columns: list[list], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, (_, kind) in zip(columns, schema)],
        [name for name, _ in schema],
    )


def _observations(docs: DataFrame) -> DataFrame:
    """One scan of ``text, key, times``: ``text, entities, terms`` or ``term, times, texts`` rows.

    The former are the texts with an entity, copies of one once per task; the latter
    counts over all texts, by how many copies a text has.
    """
    entity_lists = pa.list_(pa.string())
    schema = [("text", pa.int64()), ("entities", entity_lists), ("terms", entity_lists), ("term", pa.string()), ("times", pa.int64()), ("texts", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}
        sent: set[int] = set()
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for times, terms in counts.items():
                none = [None] * len(terms)
                yield _rows([none, none, none, list(terms), [times] * len(terms), list(terms.values())], schema)
            counts.clear()

        for batch in batches:
            rows = []
            for text, key, times in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = text.as_py()
                spans = protected(text)
                terms = _terms_outside(text, spans) if spans else set(_terms(text))
                counter = counts.setdefault(times, Counter())
                held -= len(counter)
                counter.update(terms)
                held += len(counter)
                if spans and key not in sent:
                    sent.add(key)
                    entities = sorted({_entity(kind, text[a:b]) for kind, a, b in spans})
                    rows.append((key, entities, sorted(terms), None, None, None))
                if held >= _FLUSH:
                    yield from flush()
                    held = 0
            if rows:
                yield _rows([list(column) for column in zip(*rows)], schema)
            if len(sent) >= _FLUSH:
                sent.clear()
        yield from flush()

    return docs.mapInArrow(
        run, "text bigint, entities array<string>, terms array<string>, term string, times bigint, texts bigint"
    )


def _hash(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little", signed=True)


class HashedTerms:
    """Terms with their shares by sorted 64-bit hashes; answers are kept per task."""

    def __init__(self, hashes: np.ndarray, shares: np.ndarray):
        order = np.argsort(hashes)
        self._hashes, self._shares = hashes[order], shares[order]
        self._known: dict[str, float | None] = {}

    def __len__(self) -> int:
        return len(self._hashes)

    def get(self, term: str, default=None):
        if term not in self._known:
            if len(self._known) >= _FLUSH:
                self._known.clear()
            wanted = _hash(term)
            at = int(np.searchsorted(self._hashes, wanted))
            met = at < len(self._hashes) and self._hashes[at] == wanted
            self._known[term] = float(self._shares[at]) if met else None
        share = self._known[term]
        return default if share is None else share

    def __contains__(self, term: str) -> bool:
        return self.get(term) is not None


def _hashed(terms: DataFrame) -> HashedTerms:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_hash(term) for term in batch.column(0).to_pylist()]
            yield _rows([hashes, batch.column(1).to_pylist()], [("hash", pa.int64()), ("share", pa.float64())])

    rows = terms.select("term", "share").mapInArrow(run, "hash bigint, share double").toArrow()
    return HashedTerms(rows["hash"].to_numpy(), rows["share"].to_numpy())


def _checked(terms: DataFrame) -> dict[str, float] | None:
    """The terms, if they are few enough to send to every task."""
    rows = terms.select("term", "share").limit(BROADCAST_TERMS + 1).collect()
    return {row["term"]: row["share"] for row in rows} if len(rows) <= BROADCAST_TERMS else None


def lower_share(both: Column, texts: Column) -> Column:
    """The lower end of Wilson's interval for ``both`` of ``texts``."""
    p, zz = both / texts, Z * Z
    spread = F.sqrt(p * (1 - p) / texts + zz / (4 * texts * texts))
    return (p + zz / (2 * texts) - Z * spread) / (1 + zz / texts)


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """``term, share``: how surely a term gives away the entity that it tells most of."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    times = written(texts.groupBy("key").agg(F.count(F.lit(1)).alias("times")), "disclosure-texts")
    total = times.count()
    copies = times.where("times > 1")
    few = copies.count() <= BROADCAST_COPIES
    counted = texts.join(F.broadcast(copies) if few else copies, "key", "left")
    seen = written(
        _observations(counted.select("text", "key", F.coalesce("times", F.lit(1)).alias("times"))), "disclosure"
    )
    told = written(
        seen.where("text IS NOT NULL").select("text", "entities", "terms").dropDuplicates(["text"]), "disclosure-told"
    )
    release_shuffles(docs.sparkSession)
    mentions = told.select("text", F.explode("entities").alias("entity"))
    entities = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_texts")).where("entity_texts > 1")
    entities = written(entities, "disclosure-entities")
    pairs = (
        mentions.join(entities, "entity")
        .join(told.select("text", "terms"), "text")
        .select("entity", "entity_texts", F.explode("terms").alias("term"))
        .groupBy("entity", "entity_texts", "term")
        .agg(F.count(F.lit(1)).alias("both"))
        .where("both > 1")
    )
    pairs = written(pairs, "disclosure-pairs")
    release_shuffles(docs.sparkSession)
    terms = (
        seen.where("term IS NOT NULL")
        .groupBy("term", "times")
        .agg(F.sum("texts").alias("texts"))
        .groupBy("term")
        .agg(F.sum(F.col("texts") / F.col("times")).alias("term_texts"))
    )
    base = F.col("entity_texts") / F.lit(float(max(total, 1)))
    lower = lower_share(F.col("both").cast("double"), F.round("term_texts"))
    share = F.when(base < 1, (lower - base) / (1 - base))
    found = written(
        pairs.join(terms, "term")
        .withColumn("share", share)
        .groupBy("term")
        .agg(F.max("share").alias("share"))
        .where(F.col("share") >= GENERALISE),
        "disclosing",
    )
    release_shuffles(docs.sparkSession)
    return found


def term_spans(text: str, terms) -> list[tuple[str, int, int, str]]:
    return [
        ("term", *found.span(), low)
        for found in _TERM.finditer(text)
        if (low := found[0].lower()) in terms
    ]


def spans_of(text: str, terms) -> tuple[list[Span], list[Span]]:
    """Base spans, and spans of secrets and of disclosing terms outside them."""
    base = base_spans(text)
    more = [
        span for span in secret_spans(text) if not any(span[1] < b and a < span[2] for _, a, b in base)
    ]
    if not terms or not any(term in terms for term in set(_terms(text))):
        return base, more
    taken = sorted((a, b) for _, a, b in base + more)
    for _, a, b, _ in term_spans(text, terms):
        if not any(low < b and a < high for low, high in taken):
            more.append(("term", a, b))
    return base, more


def sanitised(text: str, spans: list[Span], terms: dict[str, float]) -> str:
    """``text`` with base spans and disclosing terms replaced or removed."""
    pieces, at = [], 0
    for kind, start, end in sorted(spans, key=lambda span: (span[1], -span[2])):
        if start < at:
            at = max(at, end)
            continue
        drop = kind == "term" and terms.get(text[start:end].lower(), 0) >= REMOVE
        pieces += [text[at:start], "" if drop else f"<{kind}>"]
        at = end
    return "".join(pieces) + text[at:]


RESULT = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
    "base_sha256 string, spans string, n_secret bigint, n_terms bigint, n_spans bigint, sanitised string"
)


def _written_spans(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def sanitise(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Spans and sanitised text of every row of ``docs``; ``terms(term, share)``."""
    known = _checked(terms)
    if known is not None:
        return _sanitise(docs.select("doc_id", "text", F.lit(None).cast("array<string>").alias("t")), known)
    if terms.count() <= BROADCAST_HASHES:
        return _sanitise(docs.select("doc_id", "text", F.lit(None).cast("array<string>").alias("t")), _hashed(terms))
    # Too many terms to send: each text meets its own.  A hash of key and text
    # names the row, so equal rows share their terms.
    name = F.xxhash64("doc_id", "text")
    rows = docs.select("doc_id", "text", name.alias("row"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = sorted(set(_terms(text.as_py() or "")))
                yield _rows([[row] * len(found), found], [("row", pa.int64()), ("term", pa.string())])

    own = (
        rows.select("row", "text")
        .mapInArrow(each, "row bigint, term string")
        .distinct()
        .join(terms, "term")
        .groupBy("row")
        .agg(F.collect_list(F.concat_ws(" ", "term", F.col("share").cast("string"))).alias("t"))
    )
    return _sanitise(rows.join(own, "row", "left").select("doc_id", "text", "t"), {})


def _sanitise(rows: DataFrame, known: dict[str, float] | HashedTerms) -> DataFrame:
    names = [part.split()[0] for part in RESULT.split(", ")]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 3 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = text.as_py() or ""
                terms = known
                if own.is_valid:
                    terms = {t: float(s) for t, s in (entry.split(" ") for entry in own.as_py())}
                base, more = spans_of(text, terms)
                counts = Counter(kind for kind, _, _ in base + more)
                out.append(
                    (
                        key, *(counts[kind] for kind in KINDS),
                        hashlib.sha256(_written_spans(base).encode()).hexdigest(),
                        _written_spans(base + more), counts["secret"], counts["term"], len(base) + len(more),
                        sanitised(text, base + more, terms),
                    )
                )
            columns = list(zip(*out)) if out else [()] * len(names)
            yield _rows(columns, list(zip(names, types)))

    return rows.withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, RESULT)


def personal_data(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return sanitise(docs, disclosing_terms(docs))
