import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text[, source]) rows, with an extra column that clashes."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 0.5) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, win string, score double")

    return make
