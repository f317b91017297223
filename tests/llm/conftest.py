import pytest

from loam.llm.common import table

#: What every operator must take: nulls, empty and blank texts, repeats, and columns with clashing names.
ODD_TEXTS = [None, "", " \n\t ", "a", "It's 1st.\n\n  x y  你好 \U0001f600don't", "word " * 3000, "same text of six words here", "same text of six words here"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None, 0, "x", "y", 1.0) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id at all", None, None, None, None, None, None), (3, "a", "en", "s", 1, "x", "y", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, block string, term string, score double")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
