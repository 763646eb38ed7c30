import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ba de ki lo mu na pe ri so tu va xe".split()


def prose(words: int, seed: int) -> str:
    rng = random.Random(seed)
    out = []
    while len(out) < words:
        n = min(rng.randint(4, 12), words - len(out))
        sentence = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
        sentence[0] = sentence[0].title()
        out += sentence[:-1] + [sentence[-1] + "."]
    return " ".join(out)


ODD = [
    (None, None, None, None, None),
    (1, None, "en", "s", None),
    (2, "", "en", None, 0),
    (3, "  \n\t ", None, "s", 5),
    (4, "x", "en", "s", 1),
    (4, "x", "en", "s", 1),
    (5, "a" * 5000, "en", "s", 5000),
    (6, prose(4000, 6), "en", "s", None),
    (7, prose(300, 7), "en", "s", None),
    (8, prose(300, 7), "en", "s", None),
    (9, "<|endoftext|> and  <|startoftext|>　\U0001f642 é", "fr", "t", None),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, long and repeated texts, a repeated row."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
