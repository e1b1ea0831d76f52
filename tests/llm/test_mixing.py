import re
from collections import defaultdict

from pyspark.sql import functions as F

from goldsieve.llm.mixing import WEIGHTS, highest_quotients, mixed_documents, n_words, plan_mix, source_mix, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _targets(sizes, share=1.5, repeats=2):
    """Raise a common rate until nothing is left, source by source."""
    weights = {key: float(WEIGHTS[at % 3]) for at, key in enumerate(sorted(sizes))}
    open_, found, left = set(sizes), {}, share * sum(sizes.values())
    while open_:
        rate = left / sum(weights[key] for key in open_)
        over = {key for key in open_ if rate * weights[key] > repeats * sizes[key]}
        if not over:
            return found | {key: rate * weights[key] for key in open_}
        for key in over:
            found[key] = float(repeats * sizes[key])
            left -= found[key]
        open_ -= over
    return found


def test_targets_fill_up_to_the_caps(spark):
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 50, "c": 900, "d": 0, "e": 7}, {"a": 10}):
        df = spark.createDataFrame(list(sizes.items()), "key string, source_size bigint")
        found = {row["key"]: row["target"] for row in targets(df, 1.5, 2).collect()}
        wanted = _targets(sizes)
        assert found.keys() == wanted.keys()
        assert all(abs(found[key] - wanted[key]) < 1e-6 for key in wanted)


def _seat_by_seat(shares, seats):
    quota = dict.fromkeys(shares, 0)
    for _ in range(seats):
        best = max(sorted(shares), key=lambda key: shares[key] / (2 * quota[key] + 1))
        quota[best] += 1
    return quota


def test_highest_quotients_seat_by_seat(spark):
    groups = {
        1: ({"a": 53.0, "b": 24.0, "c": 23.0}, 7),
        2: ({f"k{n:02d}": 1.0 for n in range(40)} | {"z": 900.0}, 33),
        3: ({"a": 0.0, "b": 3.0}, 5),
        4: ({f"k{n:02d}": float(n * n + 1) for n in range(30)}, 1000),
    }
    rows = [(g, key, share, seats) for g, (parts, seats) in groups.items() for key, share in parts.items()]
    df = spark.createDataFrame(rows, "g int, key string, share double, seats bigint")
    found = defaultdict(dict)
    for row in highest_quotients(df, ["g"], "key").collect():
        found[row["g"]][row["key"]] = row["quota"]
    for g, (parts, seats) in groups.items():
        assert found[g] == _seat_by_seat(parts, seats)


def test_words(spark, texts):
    values = [None, "", " ", "\n", "a", " a b\tc\n", "a\x0b\x0cb", "\x1cx\xa0y"]
    assert texts(values, n_words) == [len(WORD.findall(value or "")) for value in values]


def test_mix_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = source_mix(docs).collect()
    assert sorted(map(tuple, plan)) == sorted(map(tuple, source_mix(docs.repartition(7)).collect()))
    texts = {row["doc_id"]: (row["source"], len(WORD.findall(row["text"]))) for row in docs.collect()}
    sizes, taken, wanted = defaultdict(int), defaultdict(int), {}
    for row in plan:
        source, size = texts[row["doc_id"]]
        assert row["size"] == size and 0 <= row["taken"] <= 2 * size
        sizes[source] += size
        taken[source] += row["taken"]
        wanted[source] = row["target"]
    exact = _targets(dict(sizes))
    for source, target in exact.items():
        assert abs(wanted[source] - target) < 1e-6
        assert abs(taken[source] - target) <= 3 * 128


def test_texts_of_the_mix_have_the_words_taken(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = plan_mix(docs)
    mixed = mixed_documents(docs, plan)
    assert mixed.columns == docs.columns
    got = mixed.groupBy("doc_id").agg(F.sum(n_words(F.col("text"))).alias("n"), F.count(F.lit(1)).alias("copies"))
    wanted = {row["doc_id"]: row["taken"] for row in plan.where("taken > 0").collect()}
    assert {row["doc_id"]: row["n"] for row in got.collect()} == wanted
    assert mixed.where(F.length("text") != F.col("n_chars")).count() == 0


def test_odd_rows_and_none(odd_docs):
    rows = source_mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(row["taken"] <= 2 * row["size"] for row in rows)
    assert source_mix(odd_docs.where("false")).count() == 0
    assert mixed_documents(odd_docs, plan_mix(odd_docs)).where("text IS NULL").count() == 0


def test_other_columns_have_any_names_and_reruns_agree(docs_of):
    docs = docs_of([(5, "a b c " * 60, "s"), (5, "d e f " * 60, "s"), (None, "g h", None), (7, "x " * 300, "t")])
    more = docs.selectExpr("*", "1 AS _mix_picks", "2 AS size", "3 AS picks", "4 AS `key`")
    one, two = (sorted(map(repr, mixed_documents(more, plan_mix(more)).collect())) for _ in range(2))
    assert one and one == two
    assert mixed_documents(more, plan_mix(more)).columns == more.columns
