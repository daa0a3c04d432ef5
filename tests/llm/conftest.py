import pytest

LONG = "word " * 3000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and columns whose names clash."""
    text = "The quick brown fox jumps over the lazy dog and then the cat sat on the mat"
    rows = [
        (1, text, "en", "a", 1.0, "x"), (1, text, "en", "a", 1.0, "x"), (2, None, None, None, None, None), (3, "", "en", "a", 1.0, "x"),
        (4, LONG, "en", "b", 2.0, "y"), (None, text + " again", "en", None, 3.0, "z"), (5, text.upper(), "en", "b", 1.0, "x"),
        (6, "  ", "de", "b", 1.0, "x"), (7, "éa É. Σ 漢字 ́x", "fr", "é", 1.0, "x"), (8, text, "en", "b", None, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row double, id string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
