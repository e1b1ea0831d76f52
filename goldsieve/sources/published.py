"""Runs that readers see whole or not at all.

Each publication writes its rows to a folder of its own, ``<root>/data/publish=N``, and
only then the manifest ``<root>/manifests/version=N``: one row for each run that counts,
with the publication that holds it.  Readers take the newest manifest whose write came to
its end, so a run that is being written, was cut off, or was replaced is never read, and
one that is being read does not change.  A manifest has as many rows as there are runs.

One publisher at a time may write to a root; readers need no care.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from goldsieve import schemas
from goldsieve.sources.readers import json_lines
from goldsieve.sources.writers import kept_labels, result_labels, write_kept, write_results
from goldsieve.streaming.sinks import complete, delete, numbered

_MANIFEST = T.StructType(
    [
        T.StructField("publish", T.LongType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    ]
)

Runs = list[tuple[int, dict[str, str]]]


def _data(root: str) -> str:
    return f"{root}/data"


def _manifests(root: str) -> str:
    return f"{root}/manifests"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that can be read, oldest first."""
    return complete(spark, _manifests(root), "version")


def runs(spark: SparkSession, root: str, version: int | None = None) -> Runs:
    """The runs of a version, the newest one if none is named, by publication."""
    whole = versions(spark, root)
    if version is not None and version not in whole:
        raise ValueError(f"{root} has no version {version}")
    if not whole:
        return []
    manifest = f"{_manifests(root)}/version={whole[-1] if version is None else version}"
    rows = spark.read.schema(_MANIFEST).json(manifest).collect()
    return sorted(((row["publish"], row["labels"]) for row in rows), key=lambda run: run[0])


def publish(
    spark: SparkSession, root: str, labels: dict[str, str], write: Callable[[str], None]
) -> int:
    """Let ``write`` fill a new folder, then make it the run of these labels; its version.

    It takes the place of an earlier run with the same labels and leaves the others.
    """
    taken = numbered(spark, _data(root), "publish") + numbered(spark, _manifests(root), "version")
    version = max(taken, default=0) + 1
    write(f"{_data(root)}/publish={version}")
    others = [run for run in runs(spark, root) if run[1] != labels]
    manifest = spark.createDataFrame([*others, (version, labels)], _MANIFEST).coalesce(1)
    manifest.write.json(f"{_manifests(root)}/version={version}")
    return version


def publish_kept(
    kept: DataFrame,
    root: str,
    teacher: str,
    dataset: str,
    mode: str,
    split: str,
    compression: str | None = None,
) -> int:
    """:func:`~goldsieve.sources.writers.write_kept`, published."""
    run = (teacher, dataset, mode, split)
    return publish(
        kept.sparkSession,
        root,
        kept_labels(*run),
        lambda path: write_kept(kept, path, *run, compression=compression),
    )


def publish_results(
    results: DataFrame,
    root: str,
    model: str,
    teacher: str,
    dataset: str,
    mode: str,
    note: str = "",
    with_adapter: bool = True,
) -> int:
    """:func:`~goldsieve.sources.writers.write_results`, published."""
    run = (model, teacher, dataset, mode, note, with_adapter)
    return publish(
        results.sparkSession,
        root,
        result_labels(*run),
        lambda path: write_results(results, path, *run),
    )


def _read(
    spark: SparkSession,
    root: str,
    record: T.StructType,
    run: T.StructType,
    version: int | None,
    chosen: dict[str, str],
) -> DataFrame:
    # A folder cannot be named after the empty string.
    wanted = {name: value or "none" for name, value in chosen.items()}
    folders = [
        f"{_data(root)}/publish={number}"
        for number, labels in runs(spark, root, version)
        if wanted.items() <= labels.items()
    ]
    return json_lines(spark, folders, record, run, chosen, base=_data(root))


def read_published_kept(
    spark: SparkSession, root: str, version: int | None = None, **run: str
) -> DataFrame:
    """Published kept completions, of the newest version or of an earlier one."""
    return _read(spark, root, schemas.KEPT, schemas.KEPT_RUN, version, run)


def read_published_results(
    spark: SparkSession, root: str, version: int | None = None, **run: str
) -> DataFrame:
    return _read(spark, root, schemas.RESULT, schemas.RESULT_RUN, version, run)


def drop_superseded(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` versions; the publications that went.

    Folders up to the newest version that no kept one names go, those of publishers that
    were cut off too.  Later folders may be at work and stay.
    """
    if keep < 1:
        raise ValueError("keep must be at least 1")
    whole = versions(spark, root)
    if not whole:
        return []
    kept = whole[-keep:]
    named = {number for version in kept for number, _ in runs(spark, root, version)}
    for version in numbered(spark, _manifests(root), "version"):
        if version < whole[-1] and version not in kept:
            delete(spark, f"{_manifests(root)}/version={version}")
    found = numbered(spark, _data(root), "publish")
    gone = [number for number in found if number <= whole[-1] and number not in named]
    for number in gone:
        delete(spark, f"{_data(root)}/publish={number}")
    return gone
