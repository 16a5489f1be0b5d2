import pytest

#: A text of each odd kind; ids repeat, stand alone or are null.
TEXTS = [None, "", " ", "\n\n", "a", "Ünïcödé ß 日本語 😀", "the cat " * 3000, "x" * 50_000, "one two three four five six seven eight nine ten", "1234 5678 !!!", "a\tb\r\nc  d\n\n e", "\x1c\u00a0odd\u2003white\u0085space", "<|endoftext|> it's"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with names of results."""
    rows = [(i, t, "en", "s", 7) for i, t in enumerate(TEXTS)] + [(None, "no id here", None, None, None), (8, TEXTS[8], "en", "s", 7), (8, "another text of the same id", "fr", "s", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n_words int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
