"""Hard inputs that every operator must take: nulls, empty and long texts, repeated rows, clashing extra columns."""

import pytest

LONG = "lorem ipsum dolor sit amet " * 20_000
#: Columns whose names the operators use inside.
EXTRA = "size int, label int, comp long, key string, score double, copy int, position double, row long, kind string, item_id long"


def rows():
    base = [
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "b", 10),
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "b", 10),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, "   \n\t ", "fr", "b", 3),
        (5, "one", "fr", "c", 3),
        (None, "a text without any id at all but with words", "en", None, 5),
        (None, None, None, None, None),
        (6, LONG, "en", "a", len(LONG)),
        (7, "\x00\ufffd caf\u00e9 \U0001f600 \u65e5\u672c", "xx", "\u00e9", 9),
    ]
    return [(*r, 1, None, 7, "k", 0.5, 1, None, 3, None, 2) for r in base]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(rows(), f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def empty(spark, hard):
    return spark.createDataFrame([], hard.schema)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
