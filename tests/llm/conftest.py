import os

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, set bigint, n string, _set string, vector int"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns of clashing names."""
    long = "very long text of words that go on and on " * 4000
    near = " ".join(f"w{i}" for i in range(200))
    rows = [(1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, long, "en"), (4, long, "en"), (5, near, None), (6, near + " more", "fr"),
            (7, near, "fr"), (None, near, "fr"), (None, None, None), (8, "one two", "en"), (9, "ONE two", "en"), (10, "x" * 70_000, "de"),
            (11, "é ß ñ 漢字 😀 <|endoftext|> \x00 ²", "es"), (None, "alone here with its own six words", "en")]
    return spark.createDataFrame([(i, t, l, "s", None, 1, "n", "s", 2) for i, t, l in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]),
            (9, [1.0, 0.0]), (None, [1.0, 0.0]), (20, [1.0, 0.01]), (40, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (60, None)]
    return spark.createDataFrame([(i, v, 0, "own") for i, v in rows], "vec_id bigint, embedding array<float>, label int, own string")
