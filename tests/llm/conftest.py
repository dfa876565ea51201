import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, columns whose names clash with inner ones."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    rows = [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, None, None, None, None), (None, "a b c d e", "en", "s", 9), (None, None, None, None, None), (3, "", "en", "s", 0), (4, " \n\t ", "en", "s", 4), (5, long, "de", "s", len(long)), (6, "Ünïcode ☃ text " * 40, "de", None, 600), (7, "12345 !!!", "en", "s", 9)]
    return spark.createDataFrame([(*r, -1, "x", "y", 0.5, 7) for r in rows], DOCS + ", row long, word string, key string, score double, part long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
