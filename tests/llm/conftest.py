from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, key long, id string"


def make_texts(seed: int = 3, n: int = 60) -> list[str | None]:
    """Null, empty, short, repeated, near-equal and long texts with shared passages."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(300)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage = words(70)
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two three", "a b c d"]
    base = [words(r.randint(5, 400)) for _ in range(n // 3)]
    for w in base:
        texts.append(" ".join(w))
        near = list(w)
        near[len(near) // 2] = "changed"
        texts.append("  ".join(near) if r.random() < 0.3 else " ".join(near))
        if r.random() < 0.5:
            texts.append(" ".join(w))
        if r.random() < 0.5:
            texts.append(" ".join([*words(30), *passage, *words(r.randint(0, 40))]))
    texts.append(" ".join(words(6000)))
    texts.append("same " * 300)
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with extra columns whose names operators might use, nulls in them, and a repeated row."""
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"src{i % 3}", None, "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[8]], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
