import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, fp string, _k1 string, label string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (id, text) with extra columns whose names the operators use themselves."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", "z", "w") for i, t in rows], COLUMNS)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every place, empty and very long texts, ties and repeated rows."""
    return [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "lone words here"), (3, ""), (4, " \t\n"),
            (5, "word " * 60_000), (6, "a b c d e f"), (None, None), (7, "ünïcode 日本語 text €"), (8, "|"), (9, "123 456")]
