import pytest

LONG_TEXT = " ".join(f"w{i % 977}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated
    rows, and extra columns whose names clash with the operators' own."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "en", "a", 70, 1),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "en", "a", 70, 2),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "en", "a", 70, 2),
        (3, None, None, None, None, None),
        (4, "", "en", "b", 0, 3),
        (5, " \t\n \x0b", "de", "b", 5, 4),
        (6, LONG_TEXT, "en", "c", len(LONG_TEXT), 5),
        (7, "one", "en", "c", 3, 6),
        (8, "éà 日本語 😀 two words\nsame line\nsame line\n", "fr", None, 9, 7),
        (None, "a text without an id stands here and is long enough to count", "en", "a", 60, 8),
        (9, "ALPHA Beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "en", "d", 70, 9),
    ]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int"
    ).selectExpr("*", "score as _text_hash", "score as u", "score as size", "score as root", "score as _t")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (2, 0, 0), (6, 1, 0), (7, 0, 1), (9, None, None), (None, 1, 0), (99, 1, 0)],
        "doc_id bigint, quality int, toxic int")
