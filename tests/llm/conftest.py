import pytest

from clauseloom.llm.common import read

LONG = "word and more words here " * 8000


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, an empty and a very long text, repeated rows, ties and clashing extra columns."""
    rows = [
        (1, "One two three four five six seven eight.", "en", "b", 40, 1.0, "x", 0),
        (2, "One two three four five six seven eight.", "en", "b", 40, 1.0, "x", 0),
        (2, "One two three four five six seven eight.", "en", "b", 40, 1.0, "x", 0),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "a", 0, 0.5, "y", 1),
        (None, "Mail me at some.one@mail.example.org or +1 (555) 123-4567 now", "en", "a", 50, 0.5, "y", 1),
        (None, None, "en", "a", None, 0.5, "y", 1),
        (7, LONG, "de", None, len(LONG), 0.2, "z", 2),
        (8, " \t\n ", "fr", "ä", 4, 0.2, "z", 2),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, size int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return read(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)
