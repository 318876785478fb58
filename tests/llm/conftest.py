import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, node string, __kept string, __base string, __k1 string, __row int, row int, base_failed int"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, blanks, repeated rows, ties, a very long text, and columns whose names the operators use."""
    words = "the of and to in was with that for on it is as by be are this from".split()
    long = " ".join(f"{words[i % 18]} wort{i % 977}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat. It was a fine day, and the cat was glad of it", "en", "a", 3, "x", "y"),
        (1, "the cat sat on the mat. It was a fine day, and the cat was glad of it", "en", "a", 3, "x", "y"),
        (2, None, "en", "a", None, None, None),
        (3, "", None, None, 0, None, None),
        (4, "  \n \t\n\n  ", "en", "b", 8, None, None),
        (5, long, "en", "b", len(long), None, None),
        (6, "été 🙂 <|endoftext|> don't\n \n  x", "fr", "c", 5, None, None),
        (None, "no id here", None, "c", 5, None, None),
        (7, "x", "de", "a", 1, None, None),
    ]
    return spark.createDataFrame([(*r, "mine", "own", "key", 9, 8, 7) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
