import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(DATA):
        pytest.skip("test data not mounted")
    return DATA


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty, blank and very long texts, repeated rows and columns with names used inside."""
    long = " ".join(f"w{i % 7001}" for i in range(60_000)) + "é" * 3000
    rows = [(1, "one two three four five six seven eight nine ten eleven", "en", "a"), (2, None, None, None), (3, "", "en", "a"),
            (4, " \t\n ", "de", None), (5, long, "en", "b"), (6, "one two three four five six seven eight nine ten eleven", "en", "a"),
            (1, "one two three four five six seven eight nine ten eleven", "en", "a"), (None, "no id here at all my friend", "en", "a"),
            (None, None, None, None), (7, "#" * 50, "en", "a"), (8, "a\nb\na\nb\n" * 40, "en", "b")]
    return spark.createDataFrame([(*r, 0, "x", b"y", 3.0) for r in rows],
                                 "doc_id long, text string, lang string, source string, n int, text_key string, digest binary, score double")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
