import zlib

import numpy as np

from goldsieve.llm.quality_trees import STATISTICS, fit_trees, keep_quality, quality_scores, score_rows, statistics


def _walk(model, row):
    total, (trees, nodes) = model.base, model.split.shape
    for tree in range(trees):
        node = 0
        while node < nodes:
            over = row[model.split[tree, node]] > model.threshold[tree, node]
            node = 2 * node + 1 + int(over)
        total += model.leaf[tree, node - nodes]
    return 1 / (1 + np.exp(-total))


def test_flat_walk_is_the_node_walk():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(300, 5))
    labels = ((rows[:, 0] > 0.2) ^ (rows[:, 3] > 0)).astype(float)
    model = fit_trees(rows, labels, trees=30, depth=3)
    scores = score_rows(model, rows)
    assert np.allclose(scores, [_walk(model, row) for row in rows])
    assert ((scores > 0.5) == labels).mean() > 0.97
    assert score_rows(model, rows[:0]).shape == (0,)


def test_statistics_are_numbers():
    for text in ("", " ", "\n\n", "a", "A!! B!!", "x" * 100_000, "wörd " * 1000, "퟿\U0001f600 1 2"):
        row = statistics(text)
        assert len(row) == len(STATISTICS) and np.isfinite(row).all()


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    found = quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [row for row in found if row["held_out"]]
    assert all(row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2) for row in found)
    assert np.mean([row["predicted"] == row["quality"] for row in held]) >= 0.95
    assert all(0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.7) for row in found)


def test_labels_of_held_out_rows_change_nothing(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    turned = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(cast(string(doc_id) AS binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality"
    )
    assert sorted(map(tuple, quality_scores(docs, labels).collect())) == sorted(
        map(tuple, quality_scores(docs.repartition(3), turned).collect())
    )


def test_odd_rows_and_no_labels(odd_docs, labels_of):
    rows = quality_scores(odd_docs, labels_of([(None, 1, 0), (5, None, 0), (4, 1, 0)])).collect()
    assert len(rows) == odd_docs.count() and {row["score"] for row in rows} == {0.5}
    labelled = labels_of([(n, n % 2, 0) for n in range(1, 10)] + [(4, 1, 0)])
    assert quality_scores(odd_docs, labelled).count() == odd_docs.count()
    assert quality_scores(odd_docs.where("false"), labelled).count() == 0
    assert keep_quality(odd_docs, None).count() == odd_docs.count()
