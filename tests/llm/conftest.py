import random

import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, digest string, c long, key long"


def long_text(seed: int = 3, words: int = 30_000) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta token one two 3 vier cinq".split()) + str(rng.randrange(900)) for _ in range(words))


def odd_rows() -> list[Row]:
    """Nulls, blanks, one word, repeated rows, a null id and source, a very long text; extra columns that clash."""
    text = "The quick brown fox jumps over the lazy dog near the river bank, and then it sleeps in the sun."
    rows = [
        (1, text, "en", "a"), (2, None, "en", "a"), (3, "", "de", "b"), (4, " \t\n", None, "b"), (5, "word", "fr", None),
        (6, text, "en", "a"), (6, text, "en", "a"), (None, text, "en", "c"), (None, None, None, None),
        (7, long_text(), "en", "a"), (8, text.upper(), "en", "b"), (9, "!!! ### 12", "es", "c"), (10, "é" * 70_000, "fr", "c"),
    ]
    return [(i, t, lang, source, len(t) if t else None, 7, 0.5, "x", 3, 4) for i, t, lang, source in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 1), (8, 0, 1), (None, 1, 1), (3, None, None), (1, 1, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
