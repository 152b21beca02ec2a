"""Small tables for the operators of the llm subpackage."""

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows to a DataFrame; the schema is a DDL string."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(frame):
    """Texts by id; further columns have names that operators use inside."""

    def make(texts):
        rows = [(i, t, "x", 1, 2.0, "k") for i, t in texts]
        return frame(rows, "doc_id long, text string, score string, row long, start double, label string")

    return make
