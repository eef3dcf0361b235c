import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, _key string, kept string, node long, _spans string, items string, n_hit string, _host string, _drop string, _kept string, n_lines string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash with the operators' own."""

    def make(rows, lang="en", source="s"):
        return spark.createDataFrame([(d, t, lang, source, None if t is None else len(t), "r", "k", "x", 1, *"abcdefg") for d, t in rows], DOCS)

    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "null id here"), (4, "same text again"), (4, "same text again"), (5, "x" * 50_000), (6, "w " * 30_000)]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)
