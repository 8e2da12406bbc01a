import random

import pytest

from kerbline.llm.storage import shipped

#: Columns whose names the operators use themselves.
CLASHING = ("id", "row", "node", "bucket", "size", "key", "doc", "gone", "copies", "label", "n", "part", "kind", "a")


@pytest.fixture(scope="session", autouse=True)
def _package(spark):
    shipped(spark)


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text[, lang, source]) with extra columns of clashing names."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), *["x"] * len(CLASHING)) for r in rows]
        kind = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame(full, kind).repartition(3)

    return make


@pytest.fixture
def prose():
    """Invented sentences of a fixed seed."""

    def make(n, seed=7, low=5, high=60):
        rng = random.Random(seed)
        syllables = ["the", "er", "an", "in", "tion", "re", "on", "at", "en", "nd", "ou", "ha", "st", "wh", "éa", "ñu", "ß"]
        word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
        return [" ".join(word() for _ in range(rng.randint(low, high))) + "." for _ in range(n)]

    return make
