"""Reading problem sets, completions and earlier outputs, always with a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldsieve import schemas

CORRUPT = "_corrupt_record"


def read_problems(
    spark: SparkSession, path: str, split: str | None = None, file_format: str = "parquet"
) -> DataFrame:
    """Raw problems; with ``split``, only that ``split=..`` partition."""
    schema = schemas.PROBLEM
    if split is not None:
        schema = T.StructType([*schema.fields, T.StructField("split", T.StringType())])
    reader = spark.read.schema(schema)
    if file_format == "csv":
        # A solution has several lines.
        reader = reader.options(header=True, multiLine=True, escape='"')
    problems = reader.format(file_format).load(path)
    return problems if split is None else problems.where(F.col("split") == split)


def json_lines(
    spark: SparkSession,
    path: str | list[str],
    record: T.StructType,
    run: T.StructType,
    chosen: dict[str, str],
    base: str | None = None,
) -> DataFrame:
    """JSON lines under run folders; only the chosen folders are opened.

    A broken line comes back with nulls and its text in ``_corrupt_record``.
    ``base`` is the folder that several paths lie in; no path at all is an empty table.
    """
    unknown = sorted(set(chosen) - set(run.fieldNames()))
    if unknown:
        raise ValueError(f"not folder levels of this table: {unknown}")
    corrupt = T.StructField(CORRUPT, T.StringType())
    schema = T.StructType([*record.fields, corrupt, *run.fields])
    if not path:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    if base is not None:
        reader = reader.option("basePath", base)
    lines = (
        reader.option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
        .select(*schema.fieldNames())
    )
    for name, value in chosen.items():
        # A folder cannot be named after the empty string.
        lines = lines.where(F.col(name) == (value or "none"))
    return lines


def read_kept(spark: SparkSession, path: str, **run: str) -> DataFrame:
    """Kept completions, for example ``read_kept(spark, path, mode="boring")``."""
    return json_lines(spark, path, schemas.KEPT, schemas.KEPT_RUN, run)


def read_results(spark: SparkSession, path: str, **run: str) -> DataFrame:
    return json_lines(spark, path, schemas.RESULT, schemas.RESULT_RUN, run)


def read_completions(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    return spark.read.schema(schemas.COMPLETION).format(file_format).load(path)


def completion_stream(
    spark: SparkSession,
    path: str,
    files_per_batch: int | None = None,
    file_format: str = "json",
) -> DataFrame:
    stream = spark.readStream.schema(schemas.COMPLETION).format(file_format)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.load(path)
