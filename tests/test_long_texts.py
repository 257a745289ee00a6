"""Texts of 20,000 words go through every step, and the patterns that were made safe find what their plain forms find."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import patterns as R
from vellum.functions import redact

WORDS = "alpha beta gamma me be some number state place street paper with by and".split()
N = 20_000
SHAPES = {
    "lower": lambda r: " ".join(r.choice(WORDS) for _ in range(N)),
    "capitals": lambda r: " ".join(r.choice(WORDS).capitalize() for _ in range(N)),
    "dots": lambda r: ".".join(r.choice(WORDS) for _ in range(N)),
    "numbers": lambda r: " ".join(str(r.randint(1, 99_999)) if r.random() < 0.1 else r.choice(WORDS) for _ in range(N)),
    "fragments": lambda r: " ".join(r.choice(["alpha", "Beta,", "High School", "Ltd, Foo", "wrote a paper with Foo", "MBA", "12 Main Street", "School,"]) for _ in range(N)),
}

#: (safe pattern, plain form, group, pieces that make texts for it)
PLAIN = {
    "school": (R.SCHOOL, R.I + r"(?:[A-Z][\w'.]+\s+)*" + R._SCHOOL + r"(?:\s*,\s*[A-Za-z]+)?", ["High", "school", "School", "Academy", "a", "St.", "Hr.", "Sec.", "Hr.Sec.", "foo", "Bar's", "x9", "9y", "Public", ",", "Ohio", "\n", "é", "aHigh"]),
    "generic": (R.GENERIC_SCHOOL, R.I + r"(?:St\.?\s+)?(?:[A-Za-z][a-zA-Z'.]+\s+){1,4}(?:School|College|Academy|Vidyalaya)\b", ["St.", "best", "a", "School", "College", "foo", "B.", "é", "9", "it's", ",", "qux"]),
    "bare_url": (R.URL_NO_PROTO, R.I + r"(?<![@A-Za-z0-9])(?:[a-zA-Z0-9\-]+\.)+(?:" + "|".join(R.TLDS) + r")(?:/[^\s,)]*)?", ["a.", "com", "b.", "io", "co", "com.", "-x.", "@", "in", "/p", " ", "org.", "éa."]),
    "e-mail": (R.EMAIL, R.P + r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", ["a", "b.", "@", "c.com", ".", "é", " ", "x@y.org", "-", "_"]),
    "company": (R.COMPANY_LINE, "(?m)" + R.P + r"^(?:.*(?:Networks|Pvt|Ltd|Inc|Corp)\s*\.?),\s*(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*$", ["Ltd", ".", ",", "Foo", "Bar", "\n", "x", "Inc", "Corp,"]),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_long_texts_pass_every_step(spark, shape):
    df = redact.start(spark.createDataFrame([("c", SHAPES[shape](random.Random(3)))], "candidate_id string, text string"))
    for name, step in redact.steps():
        assert step(df).select(F.length("text").alias("n")).first()["n"] >= 0, name
    assert df.select(redact.validate(F.col("text")).alias("v")).first()["v"]["confidence_score"] >= 0


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_safe_patterns_equal_plain_ones(spark, name):
    safe, plain, pieces = PLAIN[name]
    rng = random.Random(name)
    rows = [("".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 14))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string").select("t", F.regexp_replace("t", safe, "<>").alias("got"), F.regexp_replace("t", plain, "<>").alias("want"))
    assert df.where("want != t").count() > 50
    assert df.where("got != want").limit(3).collect() == []
