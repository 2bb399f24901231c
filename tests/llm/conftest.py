import pytest

SMALL = "/root/testdata/sf0.001"

#: Columns that clash with names the operators use inside.
EXTRA = "id string, n int, pivot int, tile int, route int, gone int, bin_id int, spans string"
CLASH = ("x", 1, 2, 3, 4, 5, 6, "y")


@pytest.fixture(scope="session")
def small(spark):
    """A table of the smallest set by name."""
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, an empty text, one of 300,000 characters, repeats and clashing columns."""
    long = "the quick brown fox said that it was not there " * 6500
    texts = [(1, "A plain text of some words."), (1, "A plain text of some words."), (2, "A plain text of some words."), (3, None), (4, ""), (None, "No id here."), (5, long), (6, "…!? 123"), (7, "a")]
    rows = [(i, t, "en" if t else None, "s", len(t or ""), *CLASH) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def odd_vectors(spark):
    """Vectors with nulls, NaN, infinity, an empty one, ties, repeats and clashing columns."""
    nan, inf = float("nan"), float("inf")
    vs = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (None, [1.0, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [0.0, 0.0]), (10, [0.6, 0.8])]
    return spark.createDataFrame([(i, v, 0, *CLASH) for i, v in vs], f"vec_id bigint, embedding array<float>, label int, {EXTRA}")
