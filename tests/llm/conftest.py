import pytest

NAMES = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf01():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    long = "lorem ipsum dolor sit amet " * 4000
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta", "en", "a", 5), (2, None, None, None, None), (3, "", "de", "a", 0), (4, " \n\t\n ", "de", "b", 5),
        (5, long, "fr", "b", None), (6, "alpha beta gamma delta epsilon zeta eta", "en", None, 1), (6, "alpha beta gamma delta epsilon zeta eta", "en", None, 1),
        (None, "one two three", "en", "a", 1), (None, None, None, None, None), (7, "Ünïcödé 😀 ▁x\x00y", "es", "", 3), (8, "x", "en", "a", 1), (8, "y z", "en", "a", 1),
    ]
    return spark.createDataFrame(rows, NAMES)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], NAMES)
