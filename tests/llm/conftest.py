from __future__ import annotations

import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, _id string, _hash long, fp long, word string, spans string, host string, key string"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    extra = ("x", 1, 2, "y", "z", "h", "k")
    full = [(i, t, "en", s, None if t is None else len(t), *extra) for i, t, s in rows]
    return spark.createDataFrame(full, KIND)


@pytest.fixture(scope="session")
def nasty_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "Omega", "été", "straße", "x1", "the", "of"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    long = " ".join(prose(20) for _ in range(2000))
    one = prose(40)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, one, "a"), (4, one, "a"), (5, one, "b"), (6, one + " tail", "b"), (None, one, "a"), (None, None, None),
        (7, long, "c"), (8, "ünï\ud7ff \x1c\x85 <|endoftext|> İ ΣΑΣ.", "c"), (9, prose(60), "c"), (10, "word", "c"), (11, "a b", "c"), (9, prose(30), "c"), (2**60 + 1, prose(12), "d"),
    ]


@pytest.fixture(scope="session")
def nasty(spark, nasty_rows):
    return docs_of(spark, nasty_rows)


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.limit(0)
