import pytest

from commitlore.llm.common import table  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, items string, turns int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with the names of outputs."""
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [
        (1, "one two three four five six", "en", "a", 27, 0.5, 1, "x", 1), (1, "one two three four five six", "en", "a", 27, 0.5, 1, "x", 1),
        (2, None, None, None, None, None, None, None, None), (3, "", "en", "b", 0, None, 2, None, 3), (4, "  \n\t ", None, "b", 5, 1.0, None, "y", None),
        (5, long, "en", "a", len(long), 2.0, 3, "z", 5), (6, long + " end", "en", None, len(long) + 4, 2.0, 3, "z", 5), (None, "no id here", "fr", "b", 10, 0.0, 0, "", 0),
        (7, "é ü 漢字 </s> \\ 12 !!", "de", "c", 18, 0.0, 0, "", 0), (8, "12 34 !!", "de", "c", 8, 0.0, 0, "", 0),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
