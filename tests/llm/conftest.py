import pytest


@pytest.fixture(scope="session")
def documents_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
