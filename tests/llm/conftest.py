import pytest


@pytest.fixture()
def docs(spark):
    """Makes a documents table of (doc_id, text) rows, with what the other columns hold by default."""

    def make(rows, extra=""):
        full = [(i, t, "en" if i is not None and i % 2 else "fr", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
