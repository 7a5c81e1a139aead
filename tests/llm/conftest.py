import pytest
from edge_texts import EDGES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from texts, with an extra column."""

    def make(texts, langs=None, sources=None):
        rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or ""), i) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def edges(documents):
    return documents(EDGES, [None if i % 3 == 0 else "en" for i in range(len(EDGES))], [None if i % 4 == 0 else "s" for i in range(len(EDGES))])


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


