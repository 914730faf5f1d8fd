import pytest

#: Texts that every operator must take: null, empty, blanks, odd characters, repeats, very long.
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
TEXTS = [None, "", " \t\n ", "one", "Zwölf Boxkämpfer 😀 jagen Viktor", "a b c d e f g h " * 4, LONG, "\x00 odd \x1f control \x7f", "line\nline\n\nline\n", "É" * 50]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, a repeated row, null ids and sources, and columns whose names operators use."""
    rows = [(i, t, "s" + str(i % 2)) for i, t in enumerate(TEXTS)] + [(3, "one", "s1"), (None, "one", None), (None, None, None)]
    made = ["score", "labels", "n_words", "size", "copies", "verdict", "_row", "strong", "n_tokens", "kept", "seen", "key", "_hash"]
    return spark.createDataFrame([(*r, *range(len(made))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{m} int" for m in made))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
