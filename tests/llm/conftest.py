"""Small documents that hold the cases every operator has to stand."""

import pytest

ODD = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (None, "no id here", "en", "b", 3),
    (5, "The quick brown fox jumps over the lazy dog", "en", "a", 1), (5, "The quick brown fox jumps over the lazy dog", "en", "a", 1),
    (7, " \t\n\r\x0b\x0c ", "de", "b", 6), (8, "x" * 5000, "fr", "c", 7), (9, "word " * 3000, "en", "c", 8), (10, "Ünïcode ß 中文 \U0001f600 \x00 end", "de", None, 9),
    (11, "123 456 !!! ???", "es", "a", 10), (12, "a", "en", "a", 1), (13, "The quick brown fox jumps over the lazy cat", "en", "a", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names clash with results."""
    rows = [(*r, 0.5, "clash", 7) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, fp int").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
