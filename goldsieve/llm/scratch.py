"""Intermediate tables that go as soon as the next step has been written."""

from __future__ import annotations

from pyspark.sql import DataFrame

from goldsieve.durable import new_folder
from goldsieve.llm.shuffles import release_shuffles


class Scratch:
    """Tables in the shared folder, each with the folder it can be dropped by.

    Parquet with zstd: these tables are read once or twice and hold much disk.
    """

    def __init__(self, label: str):
        self._label = label
        self._folders: dict[int, str] = {}

    def write(self, df: DataFrame, what: str) -> DataFrame:
        folder = new_folder(df.sparkSession, f"{self._label}-{what}")
        df.write.option("compression", "zstd").parquet(folder)
        found = df.sparkSession.read.schema(df.schema).parquet(folder)
        self._folders[id(found)] = folder
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads, and the shuffle files of ended steps."""
        for table in tables:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(self._folders.pop(id(table)))
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        release_shuffles(spark)
