import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """A maker of invented texts: prose(n, seed) gives n words."""
    vocabulary = [a + b + c for a in "bdfklmnprst" for b in "aeiou" for c in ("", "l", "n", "r", "st", "ck")]

    def make(n: int, seed: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(vocabulary) + rng.choice(("", "", "", "", ".", ",")) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def awkward(prose):
    """(doc_id, text, lang, source, n_chars) with nulls, empty, short, long and repeated texts, and odd white space."""
    texts = [None, "", " \n\t ", "one", "One two", "a b c", "A b  c", prose(120, 1), prose(120, 1), prose(30_000, 2), "x" * 5000, "é è — «q»\n\n日本 語 text", prose(120, 1).upper(), "<|endoftext|> a <|endoftext|>", "same same same same same same"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[7]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
