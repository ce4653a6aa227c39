"""Small tables for the corpus operators: nulls, empty and long texts, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi pi rho sigma tau phi chi psi omega".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, fp string"


def rows(texts, first=0):
    return [(first + i, t, "en", "src0", len(t or ""), 0.5, "x", "y") for i, t in enumerate(texts)]


def odd_texts() -> list:
    """Null, empty, blanks, repeats, near copies, one very long text, letters of other scripts."""
    rng = random.Random(5)
    texts = [None, "", " \t\n", None, "", "one", "two words", "one", "Ünïcödé ẞtraße", "a b c", "\x1c\x1d"]
    for _ in range(30):
        base = [rng.choice(WORDS) for _ in range(rng.randint(3, 120))]
        texts.append(" ".join(base))
        if rng.random() < 0.5:
            texts.append(" ".join(base))
        if rng.random() < 0.5:
            base[rng.randrange(len(base))] = "changed"
            texts.append(" ".join(base))
    texts.append(" ".join(rng.choice(WORDS) for _ in range(40_000)))
    texts.append("same " * 500)
    return texts


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(odd_texts()) + rows(["one", "null id"], 900)[:1] + [(None, "no id", *rows(["x"])[0][2:])], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
