import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus(spark):
    """Rows ``(repo, path, content)`` in order as a corpus."""

    def make(*rows):
        return spark.createDataFrame(
            [(repo, path, i, content) for i, (repo, path, content) in enumerate(rows)],
            "repo string, path string, ord bigint, content string",
        )

    return make


@pytest.fixture
def apply(spark):
    """Value of a column expression for each of some texts."""

    def run(expression, *texts):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        rows = frame.select("i", expression(F.col("t")).alias("r")).collect()
        values = [row.r for row in sorted(rows, key=lambda row: row.i)]
        return values if len(texts) > 1 else values[0]

    return run
