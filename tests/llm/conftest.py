import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog " * 8, "en", "a", 1, "x"),
        (2, "the quick brown fox jumps over the lazy dog " * 8, "en", "a", 2, "x"),
        (2, "the quick brown fox jumps over the lazy dog " * 8, "en", "a", 2, "x"),
        (3, None, None, None, None, None),
        (None, "ein kleiner text über die größe der häuser und straßen", "de", "b", 3, "y"),
        (None, None, "de", None, None, None),
        (4, "", "en", "", 0, ""),
        (5, "!!! ??? 123", "en", "b", 5, "z"),
        (6, "wort " * 60_000, "de", "b", 6, "z"),
        (7, "a", "en", "c", 7, None),
        (8, "\x0b \x0c\t\r\n", "en", "c", 8, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp long, score string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
