import pytest

DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents, with more columns whose names the operators use themselves."""

    def make(rows):
        df = spark.createDataFrame(
            [(i, t, "en", "a", 1, "x", "y") for i, t in rows],
            f"{DOCS}, key long, digest string, words string",
        )
        return df

    return make
