import gzip
import hashlib
import random

import pytest

from goldsieve.llm.warc import (
    LoserTree,
    _order,
    capture_index,
    merge_runs,
    parse_records,
    read_captures,
    restored_payloads,
    url_key,
    write_archives,
)

PAGES = "page_id bigint, url string, html string"
SHARED = "<p>payload that several pages hold, and of a good length: " + "x" * 60
ROWS = [
    (5, "http://b.example/x", SHARED),
    (3, "http://a.example/y", SHARED),
    (9, "http://a.example/y", SHARED),
    (4, None, "short"),
    (6, "http://c.example/\r\nWARC-Type: fake é", "short"),
    (7, "http://www.c.example/", None),
    (8, "", ""),
    (None, "http://d.example", SHARED),
    (None, "http://d.example", "only pages without a number hold this " * 5),
    (10, "http://e.example", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 4),
    (11, "http://f.example", "ünï\r\n\x00 " * 30),
    (11, "http://f.example", "ünï\r\n\x00 " * 30),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, PAGES).repartition(3)


def test_loser_tree_merges():
    rng = random.Random(2)
    for count in (0, 1, 2, 3, 7, 8):
        runs = []
        for number in range(count):
            keys = [rng.choice([None, "a", "b", "é"]) for _ in range(rng.randint(0, 9))]
            run = [(key, str(rng.randint(0, 3)), rng.choice([None, 1, 2]), number) for key in keys]
            runs.append(sorted(run, key=_order))
        merged = list(LoserTree([iter(run) for run in runs]))
        assert list(map(_order, merged)) == sorted(map(_order, sum(runs, [])))


def test_url_keys():
    assert url_key("https://www.Blog.Example.com:80/A?b=C") == "com,example,blog)/a?b=c"
    assert url_key("example.org") == "org,example)" and url_key(None) is None


def test_index_of_odd_pages(pages):
    found = capture_index(pages).collect()
    assert len(found) == len(ROWS)
    payloads = [(html or "").encode() for _, _, html in ROWS]
    assert sorted((row["payload_bytes"], row["payload_digest"]) for row in found) == sorted(
        (len(data), hashlib.sha256(data).hexdigest()) for data in payloads
    )
    shared = hashlib.sha256(SHARED.encode()).hexdigest()
    holders = {row["page_id"]: (row["record_type"], row["refers_to"]) for row in found if row["payload_digest"] == shared}
    assert holders == {3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), None: ("revisit", 3)}
    others = [row for row in found if row["payload_digest"] != shared]
    assert all(row["record_type"] == "response" and row["refers_to"] is None for row in others)
    assert capture_index(pages.where("false")).count() == 0


def test_archives_restore_every_payload(spark, pages, tmp_path):
    path = str(tmp_path / "archives")
    write_archives(pages, path, archive_bytes=400)
    restored = restored_payloads(spark, path).collect()
    assert sorted(map(repr, map(tuple, restored))) == sorted(repr((key, html or "")) for key, _, html in ROWS)
    assert len(list((tmp_path / "archives").glob("part-*"))) > 1


def test_place_and_length_find_a_record(spark, pages, tmp_path):
    path = tmp_path / "archives"
    write_archives(pages, str(path))
    for row in read_captures(spark, str(path)).collect():
        data = gzip.decompress((path / row["archive"]).read_bytes())
        [(headers, _, _, length)] = parse_records(data[row["place"] : row["place"] + row["length"]])
        assert length == row["length"] and headers["WARC-Record-ID"].endswith(
            f":{'null' if row['page_id'] is None else row['page_id']}>"
        )


def test_runs_merge_into_global_order(spark, folder, tmp_path):
    path = str(tmp_path / "archives")
    write_archives(spark.read.parquet(f"{folder}/pages.parquet"), path, archive_bytes=10_000)
    merged = merge_runs(read_captures(spark, path), range_rows=7).collect()
    rows = [tuple(row) for row in merged]
    assert rows == sorted(rows, key=_order) and len({row[7] for row in rows}) > 5

