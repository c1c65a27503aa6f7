import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeats, clashing names."""
    long_text = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))
    rows = [(1, "a b c d e f", "en", "s", 11), (2, None, "en", "s", None), (3, "", None, None, 0),
            (None, "null id text here", "xx", "t", 1), (5, long_text, "en", "s", 1), (5, long_text, "en", "s", 1),
            (7, " \t\n ", "de", "t", 4), (8, "a b c d e f", "en", None, 11), (9, "é▁ ß\x00\U0001F600", "fr", "u", 5)]
    return spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)],
                                 DOC + ", size long, copies long")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
