import pytest

#: ties, nulls, empty, blank, repeated and long texts
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta"),
    (2, "alpha beta gamma delta epsilon zeta eta theta"),
    (3, "Alpha beta gamma delta epsilon zeta eta theta"),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "x"),
    (7, "x"),
    (None, "x"),
    (None, None),
    (9, "long " * 30_000),
    (10, "é😀 ünï " * 50),
    (11, "é😀 ünï " * 50 + "end"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in ROWS], "doc_id long, text string, partial string, top int")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
