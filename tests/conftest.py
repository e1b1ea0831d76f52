import pathlib
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from goldsieve.session import configured  # noqa: E402

DATA = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("goldsieve-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
    )
    session = configured(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return str(DATA)


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture
def texts(spark):
    """A function that maps a list of strings through one column function."""

    def run(values, function):
        rows = [(n, value) for n, value in enumerate(values)]
        df = spark.createDataFrame(rows, "n int, s string")
        found = df.select("n", function(F.col("s")).alias("out")).orderBy("n").collect()
        return [row["out"] for row in found]

    return run
