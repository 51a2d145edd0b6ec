from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept string"


@pytest.fixture(scope="session")
def odd(spark: SparkSession):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, "a b c d e f g", "en", "s1", 13, "x", "y"),
        (1, "a b c d e f g", "en", "s1", 13, "x", "y"),
        (2, "a b c d e f g", "fr", "s2", 13, None, None),
        (3, None, None, None, None, None, None),
        (4, "", "en", "s1", 0, "x", "y"),
        (None, "é ü 你好   x", "de", "s1", 9, "x", "y"),
        (None, None, None, None, None, None, None),
        (6, "long words " * 20_000, "en", "s1", 220_000, "x", "y"),
        (7, "x" * 50_000, "en", None, 50_000, "x", "y"),
        (8, " \n\t ", None, "s2", 4, "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA)
