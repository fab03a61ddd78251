from __future__ import annotations

import random

import pytest

#: An extra column, and two whose names the operators use inside.
DOCS = "doc_id long, text string, id string, digest int, score int"


def text_of(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Small documents with nulls, empty and long texts, equal rows and texts, near copies and shared passages."""
    rng = random.Random(5)
    out = [(i, text_of(rng, rng.randint(1, 120))) for i in range(60)]
    passage = text_of(rng, 60)
    out += [(100 + i, f"{text_of(rng, i)} {passage} {text_of(rng, 40 - i)}") for i in range(20)]
    out += [(200, None), (201, ""), (202, "   \n"), (203, "x"), (204, "Ab" * 400), (205, "ab" * 400), (206, "é" * 300), (207, text_of(rng, 6000))]
    out += [(300, out[3][1]), (301, out[3][1].upper()), (302, out[3][1]), (3, out[3][1]), (None, out[4][1]), (None, None)]
    long = text_of(rng, 400)
    for i in range(8):
        words = long.split()
        words[i * 40] = "changed"
        out.append((400 + i, " ".join(words)))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
