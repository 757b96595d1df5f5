import pytest


@pytest.fixture
def docs(spark):
    """Texts that strain an operator: nulls, empty and long texts, ties, repeated rows, extra columns."""
    rows = [(1, "Hello world, the cat sat on the mat.", "en"), (2, None, None), (3, "", "en"), (4, "word " * 20000, "en"), (5, "Hello world, the cat sat on the mat.", "en"), (5, "Hello world, the cat sat on the mat.", "en"), (None, "no id here", "de"), (7, "é ß 你好 🙂\n\n  x\t", "fr")]
    return spark.createDataFrame([(*r, "k", 1.5) for r in rows], "doc_id long, text string, lang string, id string, t double")


@pytest.fixture
def no_docs(docs):
    return docs.where("false")
