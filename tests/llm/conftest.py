import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def words():
    return WORDS


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with results."""
    long = " ".join(WORDS[i * 7 % 24] + str(i) for i in range(20_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 3, "x", 1),
        (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 3, "x", 1),
        (2, None, None, None, None, None, None),
        (None, "lonely text", "de", "a", 1, "x", 2),
        (3, "", "en", "b", 0, "x", 3),
        (4, "  \n\n \t ", "en", "b", 0, "x", 3),
        (5, long, "en", "a", 9, "x", 4),
        (6, "É" * 50 + " ça va là <|endoftext|> ok", "fr", "a", 1, "x", 5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash string, slot int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
