import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from goldsieve.llm.labelled import held_out

from test_decontamination import _overlap
from test_minhash import _brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_one_by_one(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], folder).write.parquet(f"{tmp_path}/{number}")
        seen.append(spark.read.parquet(f"{tmp_path}/{number}"))
    raw, good, single, clean, mixed, packed = seen
    assert all(df.columns == columns for df in seen[:-1])
    keys = [{row["doc_id"] for row in df.select("doc_id").collect()} for df in seen]
    assert keys[0] >= keys[1] >= keys[2] >= keys[3] >= keys[4] == keys[5]

    labels = spark.read.parquet(f"{folder}/labels.parquet").where(held_out(F.col("doc_id"))).collect()
    right = [(row["doc_id"] in keys[1]) == (row["quality"] == 1) for row in labels]
    assert sum(right) >= 0.9 * len(right)

    rows = [(row["doc_id"], row["text"]) for row in good.collect()]
    assert keys[2] == {key for key, _ in rows if any(found.startswith(f"({key},") and found.endswith("True)") for found in _brute(rows, 5))}

    items = [row["text"] for row in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    words = {item: set(WORD.findall(item.lower())) for item in items}
    for row in single.collect():
        own = set(WORD.findall(row["text"].lower()))
        leaks = any(_overlap(row["text"], item) for item in items if len(own & words[item]) > len(words[item]) / 3)
        assert (row["doc_id"] in keys[3]) != leaks

    sizes = {row["doc_id"]: len(WORD.findall(row["text"])) for row in clean.collect()}
    taken = sum(len(WORD.findall(row["text"])) for row in mixed.collect())
    assert abs(taken - 1.5 * sum(sizes.values())) < 0.05 * sum(sizes.values())

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = sorted((row["doc_id"], row["text"]) for row in mixed.collect())
    lengths = [(key, len(whole.encode(text, add_special_tokens=False).ids) + 1) for key, text in texts]
    got = packed.orderBy("start").collect()
    assert [(row["doc_id"], row["n_tokens"]) for row in got] == lengths
    assert [row["start"] for row in got] == [sum(n for _, n in lengths[:at]) for at in range(len(lengths))]


def test_run_is_its_stages(spark, folder):
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert one and one == two
