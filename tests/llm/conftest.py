import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(4)
    base, passage = words(rng, 120), words(rng, 60, 10_000)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " end", "en", "b"), (4, None, "en", None), (5, "", None, "b"), (6, " \t\n ", "de", "b"),
        (None, "hello world", "en", None), (None, None, None, None), (7, "one", "fr", "c"), (7, "one", "fr", "c"), (8, words(rng, 40_000), "en", "c"),
        (9, passage + " " + words(rng, 30), "de", "a"), (10, words(rng, 30) + "  " + passage, "de", "a"), (11, "日本語 テキスト ünïcode <|endoftext|> x", None, "d"),
        (12, "same same " * 60, "en", "e"), (13, "1234 5678 !!", "en", "e"), (14, "abc", "en", "a"), (14, "xyz " * 50, "en", "a"),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), 1, 2.0, "x", 3, "y") for i, t, lang, s in rows]
    return spark.createDataFrame(rows, SCHEMA + ", _size int, _row double, score string, `a.b` int, n string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
