import os

import pytest

SF = "/root/testdata"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Makes a table of documents from (id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", f"src{(i or 0) % 5}", len(t) if t is not None else None, 1, "x", "y") for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", n_words int, spans string, shard string").repartition(3)

    return make


@pytest.fixture(scope="session")
def small():
    path = f"{SF}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not here")
    return path


@pytest.fixture(scope="session")
def middle():
    path = f"{SF}/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not here")
    return path


#: Texts that every operator must take: null, empty, blank, no letters, repeated, very long, odd characters.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "12 34"), (5, "same text here now"), (5, "same text here now"), (6, "same text here now"), (None, "no id at all"), (7, "é　​\U0001f600 ́x"), (8, "word " * 20_000), (9, "a" * 50_000)]
