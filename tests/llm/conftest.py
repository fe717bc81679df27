import pytest

#: Rows that every operator must take: nulls, empty, blank, very long, ties, repeated rows, a missing id.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "a"), (5, "One two three four five six.\nOne two three four five six."), (5, "One two three four five six.\nOne two three four five six."),
    (6, "One two three four five six.\nOne two three four five six."), (7, "wörter “mit” zeichen  und\u00a0mehr 日本語 🙂 12345 don't we'll"), (8, "x" * 70_000), (9, "lang wort " * 9_000), (None, "a row without an id"), (10, "</s> [INST] <|endoftext|> control"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Also with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 0.5, "k") for r in ODD], "doc_id long, text string, fp string, score double, key string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
