"""WARC archives of pages, and their capture index by external merge.

``write_archives`` writes one record per page as real WARC 1.1 files: Spark's text
writer puts out whole records, so the committer, retries and any file system
work as for every table.  Of records with equal payloads of at least
``MIN_SHARED`` bytes, the one with the least page number is a response and the
others are revisits that refer to it and carry no payload.  First payload counts
come from narrow rows (key and digest); each page's html moves once, to archives
of about ``ARCHIVE_BYTES``.

``read_captures`` reads the archives back by content length and recomputes each
payload's digest.  Every archive gives one run, sorted by URL key, time and page.
``merge_runs`` cuts the key space at sampled splitters and merges the slices of all
runs that fall into a range with a loser tree, range after range: a capture
history in global order.  Ranges split on (key, time, page), so one URL with a
third of all captures spreads over many.

Cases: null html is an empty payload; a null URL is written without a target and
sorts first; a null page number is written as ``null``, is never referred to
while a numbered page has the payload, and comes back as null; pages that share
a number and a payload are all responses or all revisits; an empty table gives
no archives and an empty index.  Control characters and blanks in URLs are
percent-encoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldsieve.durable import new_folder, written

MIN_SHARED = 100
ARCHIVE_BYTES = 32 << 20
RANGE_ROWS = 200_000
_MARK = b"WARC/1.1"

CAPTURES = (
    "url_key string, captured string, page_id bigint, record_type string, payload_bytes bigint, "
    "payload_digest string, refers_to bigint, archive string, place bigint, length bigint"
)
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(),
          pa.string(), pa.int64(), pa.int64()]
_NAMES = [part.split()[0] for part in CAPTURES.split(", ")]


def captured_at(page_id: Column) -> Column:
    """A capture time where the table has none: one second per page number."""
    moment = F.timestamp_seconds(F.lit(1_577_836_800) + F.coalesce(page_id, F.lit(0)) % 1_000_000_000)
    return F.concat(F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def _first_holders(narrow: DataFrame) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages whose payload another page holds.

    Shared digests are grouped with a map-side step.  Those with over a
    thousandth of all pages are fewer than a thousand and are sent to the tasks;
    pages of the others are joined, none of them a hot key.
    """
    shared = narrow.where(F.col("bytes") >= MIN_SHARED)
    holders = written(
        shared.groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages"))
        .where("pages > 1 AND first IS NOT NULL"),
        "holders",
    )
    hot = F.col("pages") * 1000 > narrow.count()
    pages = shared.select("page_id", "digest")
    heavy = holders.where(hot).select("digest", "first")
    rest = pages.join(F.broadcast(heavy), "digest", "left_anti")
    found = pages.join(F.broadcast(heavy), "digest").unionByName(
        rest.join(holders.where(~hot).select("digest", "first"), "digest")
    )
    return (
        found.where(~F.col("page_id").eqNullSafe(F.col("first")))
        .groupBy("page_id", "digest")
        .agg(F.min("first").alias("refers_to"))
    )


def _record(head: Column, block: Column) -> Column:
    """A record up to its last line end, which the text writer adds."""
    size = F.octet_length(block).cast("string")
    return F.concat(head, F.lit("Content-Length: "), size, F.lit("\r\n\r\n"), block, F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One record per row of ``pages(page_id, url, html)``, in files under ``path``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    source = pages.select("page_id", "url", payload.alias("payload"))
    narrow = written(
        source.select(
            F.col("page_id").cast("bigint").alias("page_id"),
            F.sha2("payload", 256).alias("digest"),
            F.octet_length("payload").alias("bytes"),
        ),
        "digests",
    )
    refers = _first_holders(narrow)
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    files = max(1, -(-total // archive_bytes))
    dealt = source.withColumn("digest", F.sha2("payload", 256)).repartition(files, "page_id", "digest")
    match = F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest"))
    facts = refers.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")
    joined = dealt.join(facts, match, "left")
    crlf = F.lit("\r\n")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    # No unescaped blank or control character gets into a header.
    url = F.col("url")
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), crlf,
        F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">\r\n"),
        F.lit("WARC-Date: "), captured_at(F.col("page_id")), crlf,
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, crlf), F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), crlf,
        F.coalesce(
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\n"),
                F.lit("WARC-Payload-Length: "), F.octet_length("payload").cast("string"), crlf,
            ),
            F.lit(""),
        ),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    joined.select(_record(head, block).alias("value")).write.option("lineSep", "\r\n").option(
        "compression", "gzip"
    ).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview, int, int]]:
    """``headers, block, place, length`` of each record, found by content length."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + len(_MARK)] != _MARK:
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield headers, view[start:stop], at, stop + 4 - at
        at = stop + 4


def url_key(url: str | None) -> str | None:
    """Host labels in reverse order, then path and query, in lower case."""
    if url is None:
        return None
    rest = url.lower().partition("://")[2] or url.lower()
    host, slash, path = rest.partition("/")
    labels = host.partition(":")[0].split(".")
    return ",".join(reversed(labels[1:] if labels[0] == "www" else labels)) + ")" + slash + path


def _number(name: str | None) -> int | None:
    value = name.rpartition(":")[2].rstrip(">") if name else "null"
    return None if value == "null" else int(value)


def _order(row: tuple) -> tuple:
    key, captured, page = row[:3]
    return key is not None, key or "", captured, page is not None, page or 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def capture_of(headers: dict[str, str], block: memoryview, archive: str, place: int, length: int) -> tuple:
    if headers["WARC-Type"] == "revisit":
        digest = headers["WARC-Payload-Digest"].partition(":")[2]
        size = int(headers["WARC-Payload-Length"])
    else:
        payload = bytes(block).partition(b"\r\n\r\n")[2]
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        if headers["WARC-Payload-Digest"] != f"sha256:{digest}":
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    refers = headers.get("WARC-Refers-To")
    return (
        url_key(headers.get("WARC-Target-URI")), headers["WARC-Date"], _number(headers["WARC-Record-ID"]),
        headers["WARC-Type"], size, digest, _number(refers) if refers else None, archive, place, length,
    )


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures of each archive as one sorted run; ``place`` is in the unpacked file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = gzip.decompress(content.as_py())
                archive = name.rpartition("/")[2]
                found = [capture_of(h, b, archive, at, n) for h, b, at, n in parse_records(data)]
                yield _batch(sorted(found, key=_order))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, CAPTURES)


class LoserTree:
    """Merges sorted iterators: each step replays one path from a leaf to the root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self._runs = runs
        self._heads = [next(run, None) for run in runs]
        self._losers = [-1] * max(1, len(runs))
        for leaf in range(len(runs)):
            self._play(leaf)

    def _before(self, one: int, two: int) -> bool:
        a, b = self._heads[one], self._heads[two]
        if a is None or b is None:
            return b is None and (a is not None or one < two)
        return (_order(a), one) < (_order(b), two)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + len(self._runs)) // 2
        while node > 0:
            other = self._losers[node]
            if other < 0:  # while building: wait for the other side
                self._losers[node] = winner
                return
            if self._before(other, winner):
                self._losers[node], winner = winner, other
            node //= 2
        self._losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self._runs and self._heads[self._losers[0]] is not None:
            winner = self._losers[0]
            yield self._heads[winner]
            self._heads[winner] = next(self._runs[winner], None)
            self._play(winner)


def merge_runs(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all runs in global order of URL key, time and page.

    The runs lie in the shared folder first: the splitters are then sampled from
    narrow rows without reading an archive twice.  A range's rows come to its
    task run by run and in run order, and the loser tree merges them.
    """
    runs = written(captures, "runs")
    ranges = max(1, -(-runs.count() // range_rows))
    keys = ["url_key", "captured", "page_id"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                slices.setdefault(row[7], []).append(row)
        rows: list[tuple] = []
        for row in LoserTree([iter(rows) for rows in slices.values()]):
            rows.append(row)
            if len(rows) == 8192:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    dealt = runs.repartitionByRange(ranges, *keys) if ranges > 1 else runs.repartitionByRange(*keys)
    return dealt.sortWithinPartitions("archive", *keys).mapInArrow(merge, CAPTURES)


def capture_index(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, read them back, and merge the capture index."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path)
    return merge_runs(read_captures(spark, path))


def restored_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload`` of every record, revisits from the record they refer to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for content in batch.column(0):
                for headers, block, _, _ in parse_records(gzip.decompress(content.as_py())):
                    refers = headers.get("WARC-Refers-To")
                    payload = bytes(block).partition(b"\r\n\r\n")[2].decode()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([_number(headers["WARC-Record-ID"])], pa.int64()),
                            pa.array([_number(refers) if refers else None], pa.int64()),
                            pa.array([headers["WARC-Payload-Digest"]]),
                            pa.array([None if refers else payload], pa.string()),
                        ],
                        ["page_id", "refers_to", "digest", "payload"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    records = files.select("content").mapInArrow(
        run, "page_id bigint, refers_to bigint, digest string, payload string"
    )
    whole = records.where("refers_to IS NULL")
    held = whole.select(F.col("page_id").alias("refers_to"), "digest", F.col("payload").alias("held"))
    again = records.where("refers_to IS NOT NULL").join(held, ["refers_to", "digest"])
    return whole.select("page_id", "payload").unionByName(
        again.select("page_id", F.col("held").alias("payload"))
    )
