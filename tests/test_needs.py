"""Guards of redaction: a text that a pattern matches holds what the pattern needs, and guarded steps equal the plain ones."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from vellum.functions import patterns as R
from vellum.functions import redact
from vellum.functions.text import chain, folded, may_match

WORDS = (
    "He she Him hers Himself Mr. Mrs Ms. Miss Sir Madam the\u0301 he\u0301 WOMEN in Tech \u017fTEM Girl\u017f Who Code Men's Club Black Student Union Hillel Alpha Ph\u0131 mu LGBT Queer Pride Alliance Tennis "
    "pub\u0131ished wrote authored a paper March 15, 2020 \u0661\u0665 12/01/2020 12+ y\u0065ars yrs of experience Pa\u017fsing Year 2015 High \u017fchool St College Bachelor's degree from at in B.E M.Sc Ph.D. x@y.com @bob "
    "L\u0130nkedIn: l\u0131n\u212aedin.com/in/a /\u0131n/abc github.com/u HTTP\u017f://x.y www.site.com/x Age: 33 DOB: 01/02/1990 born Univer\u017fity Institute , \u00a0 \n - 's Stra\u00dfe"
).split(" ")


def texts(spark):
    r = random.Random(3)
    rows = [("".join(r.choice(WORDS) + r.choice([" ", " ", "", "  ", "\n"]) for _ in range(r.choice([2, 5, 12, 40]))),) for _ in range(1500)]
    rows += [("Pa\u017fsing Year: 2015 - 2019",), ("passing year 2015",), ("May 3, 2020",)]
    return spark.createDataFrame(rows, "text string").repartition(3).localCheckpoint()


def test_matches_hold_what_they_need(spark):
    early = next(k for k, p in enumerate(R.PROXIES) if R.GREEK in p[0])
    parts = {"PROXIES": R.PROXIES[:early], "GREEK": R.PROXIES[early : early + 1], "LATE_PROXIES": R.PROXIES[early + 1 :]}
    plain = {n: R.I + "|".join(p for p, _ in parts[n]) if n in parts else R.I + R.EXPERIENCE_YEARS if n == "EXPERIENCE_YEARS" else getattr(R, n) for n in {**R.NEEDS, **R.NEEDS_MATCH}}
    df = texts(spark).withColumn("_folded", folded(F.col("text")))
    hit = lambda n: F.col("text").rlike(plain[n])
    may = lambda n: may_match(F.col("_folded"), R.NEEDS.get(n, ()), R.NEEDS_MATCH.get(n))
    got = df.agg(*(F.count_if(hit(n)).alias(n) for n in plain), *(F.count_if(hit(n) & ~may(n)).alias(f"missed {n}") for n in plain)).first().asDict()
    assert [n for n in plain if not got[n]] == [] and [n for n in plain if got[f"missed {n}"]] == []


def test_pronouns_at_once_equal_one_by_one(spark):
    plain = F.regexp_replace(chain(F.col("text"), R.PRONOUNS, R.P), "  +", " ")
    assert texts(spark).select(redact.neutral_pronouns(F.col("text")).alias("got"), plain.alias("want")).where("got <> want").take(1) == []


def test_names_and_blanks_keep_their_meaning(spark):
    df = texts(spark)
    name = R.NAME_CHECK.replace(r"([A-Z](?<!\[[A-Z])", r"(?<!\[)([A-Z]")
    heuristic = R.HEURISTIC_NAME.replace(r"([A-Z](?<=[,;:\-–—]\s[A-Z])", r"(?<=[,;:\-–—]\s)([A-Z]")
    same = [F.regexp_extract_all("text", F.lit(new)) == F.regexp_extract_all("text", F.lit(old)) for new, old in ((R.NAME_CHECK, name), (R.HEURISTIC_NAME, heuristic))]
    assert name != R.NAME_CHECK and heuristic != R.HEURISTIC_NAME and df.where(~(same[0] & same[1])).count() == 0


def test_group_names_are_looked_for_ahead_before_behind(spark):
    guard, plain = R.NEEDS_MATCH["GREEK"], rf"(?U)[anuio](?=\s)(?<={R.GREEK.lower()})\s+{R.GREEK.lower()}"
    assert 0 < guard.find(r"(?=\s+") < guard.index("(?<=")
    r = random.Random(5)
    words = [*R.GREEK[3:-1].lower().split("|"), "delt", "pix", "nun", "xa", "etalpha"]
    df = spark.createDataFrame([("".join(r.choice(words) + r.choice([" ", "  ", "\u00a0", "\n", "", ". "]) for _ in range(r.randrange(1, 6))),) for _ in range(800)], "low string")
    told = df.select(F.col("low").rlike(guard).alias("new"), F.col("low").rlike(plain).alias("old")).groupBy("new", "old").count().collect()
    assert {(x["new"], x["old"]) for x in told} == {(True, True), (False, False)}
