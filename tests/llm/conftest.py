import random

import pytest

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, syllables="ba be bo da de ti to ra re on er an ing sh th".split()):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, sources=None, langs=None):
        rows = [(i, t, (langs or ["en"])[i % len(langs or ["en"])], (sources or ["a"])[i % len(sources or ["a"])], len(t) if t is not None else None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DDL)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, repeated rows, capitals, a very long text."""
    rng = random.Random(0)
    return [None, "", " \n\t ", "word", "word", "WORD", "é ß 😀", prose(rng, 30_000), "a" * 5000, "x y z " * 400]
