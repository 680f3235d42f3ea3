import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, texts, first=0):
    rows = [(first + k, t, "en", f"src{k % 3}", len(t) if t is not None else None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def words():
    r = random.Random(7)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 8))) for _ in range(800)]


@pytest.fixture(scope="session")
def prose(words):
    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and blank texts, repeated rows, and columns that clash with the operators' own."""
    rows = [(None, None, None), (1, "", "x"), (1, "", "x"), (2, " \n ", None), (3, None, "x"), (None, "some words that stand here", "x"), (None, "some words that stand here", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string").selectExpr("*", "1 as text_hash", "2 as tid", "3 as score", "4 as labels", "5 as near")
