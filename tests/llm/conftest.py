import random

import pytest

WORDS = "the of and to in stone river cloud lamp green seven paper north engine winter glass table orange silver window".split()


def prose(rng: random.Random, sentences: int = 12, words: int = 9) -> str:
    out = []
    for _ in range(sentences):
        s = [rng.choice(WORDS) + rng.choice(["", "", "er", "ing", str(rng.randrange(90))]) for _ in range(rng.randrange(3, 2 * words))]
        out.append(" ".join(s).capitalize() + ".")
    return " ".join(out)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    def make(texts, **columns):
        rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture
def odd_docs(spark):
    """Null and empty texts, null ids, repeated rows, a very long text, and columns with names that operators use inside."""
    rng = random.Random(4)
    a, b = prose(rng), prose(rng)
    rows = [
        (5, a, "x", 1),
        (5, a, "x", 1),
        (2, b, None, 2),
        (None, a, "x", 3),
        (7, None, "x", None),
        (8, "", "x", 5),
        (9, " \n\t ", "y", 6),
        (10, "one two", "y", 7),
        (11, "w" * 70_000 + " " + prose(rng, 400), "y", 8),
        (12, a, "y", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long").selectExpr("*", "n as id", "n as row", "text as kept", "n as c")
