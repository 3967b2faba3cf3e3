import pytest

#: columns whose names the operators use themselves
CLASHING = ["id", "row", "n", "h", "node", "gram", "block", "term", "score", "part", "at", "unit", "words", "s", "v", "q"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null ids and texts, empty and long texts, repeated rows, copies, and columns with clashing names."""
    long_text = " ".join(f"word{k % 997} Long{k}." for k in range(30_000))
    copy = "the quick brown fox jumps over the lazy dog and runs far away from here"
    rows = [
        (None, copy, None, None),
        (None, None, "en", "a"),
        (1, None, "en", "a"),
        (2, "", None, "a"),
        (3, " \t\n ", "en", None),
        (4, long_text, "de", "b"),
        (5, copy, "en", "b"),
        (5, copy, "en", "b"),
        (6, copy + " indeed", "en", "c"),
        (7, "one", "fr", "c"),
        (8, "ONE", "fr", "a"),
        (9, "Äpfel, naïve ﬁ İstanbul\x85漢字 <|endoftext|> 'LL don't", "tr", "a"),
    ]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame([r + (7,) * len(CLASHING) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
