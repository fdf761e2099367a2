import pytest

#: Null, empty, blank, tied and repeated rows, odd characters, and a long text.
TEXTS = [
    None, "", " \t\n", "one", "two words", "Three words here", "three  words\there", "THREE words here", "a b c d e f g h", "a b c d e f g h", "a b c d e f g i",
    "naïve Ωmega 中文 text 😀", "x " * 3000, "the quick brown fox jumps over the lazy dog and runs away from the angry bear in the dark old forest near the river",
    "the quick brown fox jumps over the lazy dog and runs away from the angry bear in the dark old forest near the lake",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with odd rows, columns named like those the operators add, and an id that occurs twice."""
    rows = [(k, t, "en", None if k % 5 == 0 else f"src{k % 3}", 7, "mine", k % 2 == 0, k) for k, t in enumerate(TEXTS)]
    rows += [rows[8], (None, "a b c d e f g h", "en", "src0", 7, "mine", True, 1), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, d string, kept boolean, row bigint").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
