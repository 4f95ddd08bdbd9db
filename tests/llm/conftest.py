import pytest

LONG = "Alpha beta, gamma. " * 6000     # a very long text of 18,000 words


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "One plain text of a few words.", "en", "src0", 30, 0.5, "x"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "src0", 0, 0.5, "x"),
        (4, " \n\t ", "en", "src0", 4, 0.5, "x"),
        (5, LONG, "en", "src1", len(LONG), 0.5, "x"),
        (6, "One plain text of a few words.", "en", "src0", 30, 0.5, "x"),
        (6, "One plain text of a few words.", "en", "src0", 30, 0.5, "x"),
        (None, "No id, mail me at a.b@c.example", "de", "src0", 31, 0.5, "x"),
        (7, "ünïcödé \U0001F600 ½ ß́", "de", "src0", 12, 0.5, "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
