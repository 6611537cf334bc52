import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(base / "warehouse")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Makes (doc, line_no, line) of a text for each document."""

    def make(*texts):
        rows = [(d, i, x) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n"))]
        return spark.createDataFrame(rows, "doc int, line_no bigint, line string")

    return make


@pytest.fixture
def text_of():
    """The lines of one document, in order."""

    def read(df, doc=0):
        return [r["line"] for r in df.where(df.doc == doc).orderBy("line_no").collect()]

    return read
