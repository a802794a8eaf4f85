import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and a clashing column name."""
    rows = [
        (1, "a b c", "x"), (2, "a  b\tc", "x"), (2, "a  b\tc", "x"), (3, None, None), (4, "", "x"), (None, "a b c", None),
        (5, " ", "y"), (6, "word " * 30_000, "y"), (7, "Ünï — 日本  語  　x 's <|endoftext|>", "y"), (8, "***", "z"), (None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, row string")
