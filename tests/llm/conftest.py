import pytest

from dirwise.llm.common import reachable

#: Texts that every operator must take: null, empty, blank, repeated, odd letters, very long.
ODD = [(1, None), (2, ""), (3, " \n\t \n"), (4, "one two three four five six"), (4, "one two three four five six"), (5, "one two three four five six"), (None, "no id here, but some words"), (None, None), (6, "É Σ İ 日本 \x1c \x00 ½ 😀"), (7, "word " * 60_000), (8, "a" * 200_000)]


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    reachable(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with further columns whose names operators use inside."""
    rows = [(i, t, "x", i, "y", 0.5, "z", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, pos long, key string, score double, row string, n_lines int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
