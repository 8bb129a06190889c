import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, row long, taken long, cls string"


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text[, source]) rows; it also has columns named like the operators' own."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), -1, -1, -1, -1, "x") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def messy():
    """Nulls, empty and blank texts, ties, repeated rows and a very long text."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    return [(1, None), (2, ""), (3, " \n "), (None, "a null id here"), (None, None), (5, "x"), (5, "x"), (5, "another text"),
            (6, long), (7, "same words in the same order again"), (8, "same words in the same order again"),
            (9, "ünïcödé \U0001F600 text"), (10, None)]
