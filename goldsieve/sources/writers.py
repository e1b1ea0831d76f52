"""Writing kept completions, evaluation results and training sets.

The run a file belongs to is in its path, as partition folders, so a reader
opens only the runs it asks for.  An overwrite replaces those runs alone.

Lines are plain unless a ``compression`` is named (``"gzip"``); readers tell by the file's
name.  A compressed file is read by one task, so it ends after ``FILE_RECORDS`` lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldsieve import schemas

FILE_RECORDS = 500_000


def short_name(model: str) -> str:
    """``model`` of ``organisation/model``."""
    organisation, slash, rest = model.partition("/")
    return rest.split("/")[0] if slash else organisation


def _write_lines(
    df: DataFrame,
    path: str,
    record: T.StructType,
    run: T.StructType,
    labels: dict[str, str],
    compression: str | None = None,
) -> None:
    names = run.fieldNames()
    rows = df.select(
        *record.fieldNames(),
        *(F.lit(labels[name]).alias(name) for name in names),
    )
    packed = (
        {"compression": compression, "maxRecordsPerFile": FILE_RECORDS} if compression else {}
    )
    (
        rows.write.mode("overwrite")
        .options(**packed)
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", "false")
        .partitionBy(*names)
        .json(path)
    )


def _named(labels: dict[str, str]) -> dict[str, str]:
    # A folder cannot be named after the empty string.
    return {name: value or "none" for name, value in labels.items()}


def kept_labels(teacher: str, dataset: str, mode: str, split: str) -> dict[str, str]:
    """The folder names of a run of kept completions."""
    return _named(
        {"teacher": short_name(teacher), "dataset": dataset, "mode": mode, "subset": split}
    )


def result_labels(
    model: str, teacher: str, dataset: str, mode: str, note: str = "", with_adapter: bool = True
) -> dict[str, str]:
    """The folder names of a run of evaluation results."""
    return _named(
        {
            "model": short_name(model),
            "teacher": short_name(teacher),
            "dataset": dataset,
            "mode": mode,
            "note": note,
            "with_adapter": str(with_adapter).lower(),
        }
    )


def write_kept(
    kept: DataFrame,
    path: str,
    teacher: str,
    dataset: str,
    mode: str,
    split: str,
    compression: str | None = None,
) -> None:
    """JSON lines under ``teacher=/dataset=/mode=/subset=``.

    The last level is called ``subset`` because Spark leaves partition columns
    out of the lines, and ``split`` belongs in them.
    """
    labels = kept_labels(teacher, dataset, mode, split)
    _write_lines(kept, path, schemas.KEPT, schemas.KEPT_RUN, labels, compression)


def write_results(
    results: DataFrame,
    path: str,
    model: str,
    teacher: str,
    dataset: str,
    mode: str,
    note: str = "",
    with_adapter: bool = True,
) -> None:
    """JSON lines, nulls included, under the folders that name the run."""
    labels = result_labels(model, teacher, dataset, mode, note, with_adapter)
    _write_lines(results, path, schemas.RESULT, schemas.RESULT_RUN, labels)


def write_training_set(rows: DataFrame, path: str) -> None:
    """Parquet under ``subset=train`` and ``subset=validation``."""
    side = F.when(F.col("is_validation"), "validation").otherwise("train")
    (
        rows.withColumn("subset", side)
        .drop("is_validation")
        .write.mode("overwrite")
        .partitionBy("subset")
        .parquet(path)
    )
