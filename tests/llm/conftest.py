import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, salt int, node string"


@pytest.fixture
def docs(spark):
    """Documents from texts, with ids from 0 and columns whose names clash with the operators' own."""

    def make(texts, langs=None, ids=None):
        rows = [(ids[k] if ids else k, t, langs[k] if langs else None, None if k % 3 else "src", None if t is None else len(t), "x", "y", 1, "n") for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


#: Null, empty, blank, symbols, one word, repeats, other scripts, and a very long text.
EDGES = [None, "", " \n\t", "***", "word", "Word one two. " * 3, "日本語 текст ÀÉ \U0001f600", "x" * 70_000, "a b c d e f g h i j k l m n o p " * 3000, "word", None]


@pytest.fixture
def edges():
    return list(EDGES)
