import random

import pytest


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and extra columns whose names the operators use inside."""
    rng = random.Random(8)
    base = words(rng, 80)
    texts = [None, "", " \t\n", "one", "One  ONE one", base, base, base + " tail", words(rng, 20_000), "héé ñ 漢字   x@y.example +49 (30) 1234-5678", "a" * 700, "x" * 199, "x" * 200]
    texts += [words(rng, rng.randrange(1, 60)) for _ in range(30)]
    rows = [(k, t, f"c{k}", k, b"s", k, "r") for k, t in enumerate(texts)]
    rows += [rows[5], (None, "no id here", "c", 1, b"s", 1, "r"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, c string, n long, sketch binary, h1 long, row string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
