from __future__ import annotations

import pytest


@pytest.fixture
def make(spark):
    """A DataFrame from rows and a schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def odd_documents(make):
    """Nulls, empty and white texts, a long text, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (0, None, "en", 1, "x"),
        (1, "", None, 2, None),
        (2, " \t\n ", "en", None, "y"),
        (3, "One two THREE four five six seven", "en", 3, "z"),
        (3, "One two THREE four five six seven", "en", 3, "z"),
        (4, long, "en", 4, "z"),
        (5, long + " end", "de", 5, None),
        (None, "no id at all but some words", "de", 6, "k"),
        (6, "é ß 中文   ñandú 😀", "es", 7, "k"),
    ]
    return make(rows, "doc_id long, text string, lang string, _chunk int, kept_text string")
