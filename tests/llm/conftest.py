import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"


@pytest.fixture
def make(spark):
    """A table of documents with columns whose names clash with those of results."""

    def rows(texts, langs=None, sources=None):
        data = [(i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or ""), 0.5, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(data, DOC)

    return rows
