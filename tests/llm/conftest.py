"""Small corpora with every awkward row: nulls, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("an", "be", "co", "du", "el", "fo", "gi", "ha") for b in ("ra", "ti", "mo", "lu", "ne", "sk", "vo", "py")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple[int | None, str | None]]:
    """(doc_id, text)."""
    rows: list[tuple[int | None, str | None]] = [(k, prose(k, 20 + 7 * k % 90)) for k in range(40)]
    long = prose(99, 6000)
    near = prose(7, 60).split()
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "word"), (104, "WORD"), (105, "a b c d"), (106, "A b\tc  d"), (107, long), (108, long + " end")]
    rows += [(200 + k, " ".join(near[:k] + ["changed"] + near[k + 1 :])) for k in (0, 30, 59)]
    rows += [(300, prose(3, 50)), (301, prose(3, 50)), (301, prose(3, 50)), (None, prose(3, 50)), (None, "alone here with nothing alike at all")]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with further columns, some named like those the operators make."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 0.5) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid int, kept string, score double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
