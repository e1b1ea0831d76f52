"""Published runs, and numbers that stay when rows are appended."""

import pytest

from goldsieve import schemas
from goldsieve.operators.stable_numbers import append_numbers, numbers
from goldsieve.sources import published
from goldsieve.sources.published import (
    drop_superseded,
    publish_kept,
    publish_results,
    read_published_kept,
    read_published_results,
    runs,
    versions,
)
from goldsieve.sources.writers import write_kept

RUN = ("o/t", "sums", "boring", "train")


def _kept(spark, *ids):
    filled = [(number, "s", "q", "1", "r", "1", "e", "t") for number in ids]
    return spark.createDataFrame(filled, schemas.KEPT)


def _ids(df):
    return sorted(row["id"] for row in df.collect())


def test_a_rerun_replaces_its_run_alone_and_old_versions_stay(spark, tmp_path):
    root = str(tmp_path)
    first = publish_kept(_kept(spark, 1, 2), root, *RUN)
    publish_kept(_kept(spark, 7), root, "o/t", "sums", "surreal", "train")
    last = publish_kept(_kept(spark, 3), root, *RUN)
    assert _ids(read_published_kept(spark, root)) == [3, 7]
    assert _ids(read_published_kept(spark, root, mode="boring")) == [3]
    assert _ids(read_published_kept(spark, root, version=first)) == [1, 2]
    assert versions(spark, root)[-1] == last and len(runs(spark, root)) == 2
    [row] = read_published_kept(spark, root, mode="surreal").collect()
    assert (row.teacher, row.dataset, row["mode"], row.subset) == ("t", "sums", "surreal", "train")
    with pytest.raises(ValueError):
        read_published_kept(spark, root, version=99)
    with pytest.raises(ValueError):
        read_published_kept(spark, root, colour="red")


def test_a_writer_killed_between_the_steps_leaves_the_old_run(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    publish_kept(_kept(spark, 1), root, *RUN)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(published, "runs", killed)  # the data are there, the manifest is not
        with pytest.raises(KeyboardInterrupt):
            publish_kept(_kept(spark, 2), root, *RUN)
    assert list((tmp_path / "data" / "publish=2").rglob("part-*.json"))
    assert _ids(read_published_kept(spark, root)) == [1]

    # A manifest without its mark, and data without theirs, do not count either.
    (tmp_path / "manifests" / "version=3").mkdir()
    (tmp_path / "data" / "publish=3").mkdir()
    assert _ids(read_published_kept(spark, root)) == [1]
    assert publish_kept(_kept(spark, 4), root, *RUN) == 4
    assert _ids(read_published_kept(spark, root)) == [4]


def test_an_empty_rerun_empties_its_run(spark, tmp_path):
    root = str(tmp_path)
    assert read_published_kept(spark, root).count() == 0
    publish_kept(_kept(spark, 1), root, *RUN)
    publish_kept(_kept(spark), root, *RUN)
    found = read_published_kept(spark, root)
    assert found.count() == 0 and "teacher" in found.columns


def test_superseded_runs_go_and_a_later_folder_stays(spark, tmp_path):
    root = str(tmp_path)
    for number in (1, 2, 3):
        publish_kept(_kept(spark, number), root, *RUN)
    write_kept(_kept(spark, 9), f"{root}/data/publish=4", *RUN)  # at work, not published yet
    assert drop_superseded(spark, root, keep=2) == [1]
    assert versions(spark, root) == [2, 3]
    assert (tmp_path / "data" / "publish=4").exists()
    assert _ids(read_published_kept(spark, root)) == [3]
    with pytest.raises(ValueError):
        drop_superseded(spark, root, keep=0)


def test_published_results_keep_nulls_and_empty_notes(spark, tmp_path):
    row = (1, "test", "q", "1", None, None, False)
    results = spark.createDataFrame([row], schemas.RESULT)
    publish_results(results, str(tmp_path), "o/m", "o/t", "sums", "default", note="")
    [back] = read_published_results(spark, str(tmp_path), note="").collect()
    assert tuple(back)[:7] == row and back.with_adapter == "true"


def _numbered(df):
    return {(row["a"], row["b"]): row["row_no"] for row in df.collect()}


def test_old_numbers_stay_and_new_ones_are_dense(spark, tmp_path):
    store, schema = str(tmp_path), "a int, b string, row_no string"
    first = [(5, "x", ""), (1, None, ""), (5, "x", "again"), (None, None, "")]
    before = _numbered(append_numbers(spark.createDataFrame(first, schema), ["a", "b"], store, 0))
    assert sorted(before.values()) == [0, 1, 2]
    more = [*first, (0, "y", ""), (9, "", ""), (None, "z", "")]
    rows = spark.createDataFrame(more, schema)
    after = _numbered(append_numbers(rows, ["a", "b"], store, 1))
    assert {key: after[key] for key in before} == before
    assert sorted(after.values()) == list(range(6))
    new = [key for key in sorted(after, key=after.get) if key not in before]
    assert new == [(None, "z"), (0, "y"), (9, "")]
    # Run again, and with nothing new: no change.
    assert _numbered(append_numbers(rows, ["a", "b"], store, 1)) == after
    assert _numbered(append_numbers(rows, ["a", "b"], store, 2)) == after


def test_an_append_that_was_cut_off_is_run_again(spark, tmp_path):
    store = str(tmp_path)
    rows = spark.range(4).selectExpr("id AS a")
    with pytest.raises(ValueError):
        numbers(spark, store)
    append_numbers(rows.where("a < 2"), ["a"], store, 0)
    append_numbers(rows, ["a"], store, 1)
    (tmp_path / "appends" / "append_id=1" / "_SUCCESS").unlink()
    assert numbers(spark, store).count() == 2
    found = {row["a"]: row["row_no"] for row in append_numbers(rows, ["a"], store, 1).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3}


def test_an_empty_first_append_starts_at_zero(spark, tmp_path):
    rows = spark.range(2).selectExpr("id AS a")
    assert append_numbers(rows.where("a < 0"), ["a"], str(tmp_path), 0).count() == 0
    found = append_numbers(rows, ["a"], str(tmp_path), 1).orderBy("a").collect()
    assert [row["row_no"] for row in found] == [0, 1]
    with pytest.raises(ValueError):
        append_numbers(rows, [], str(tmp_path), 2)


def test_compressed_runs_read_back(spark, tmp_path):
    from goldsieve.sources.published import publish_kept, read_published_kept

    rows = [(n, "train", f"q{n}", "1", "a\nb", "1", None, "text") for n in range(20)]
    kept = spark.createDataFrame(rows, schemas.KEPT)
    publish_kept(kept, str(tmp_path), "org/t", "sums", "boring", "train", compression="gzip")
    assert list(tmp_path.rglob("part-*.json.gz"))
    back = read_published_kept(spark, str(tmp_path)).select(*schemas.KEPT.fieldNames())
    assert sorted(map(tuple, back.collect())) == sorted(rows)
