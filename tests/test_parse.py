"""Sections and roles as expressions against the plain parser."""

from __future__ import annotations

import random
from datetime import date

from pyspark.sql import functions as F

from tests.plain_parser import roles_of, sections_of
from vellum.functions import patterns as R
from vellum.functions.parse import parse_texts, roles, sections
from vellum.functions.taxonomy import Taxonomy

AS_OF = date(2024, 1, 15)
MONTHS = ("Jan", "January", "feb", "MARCH", "May", "Sept", "sep", "December")
ENDS = ("Present", "current", "Now", "ongoing")


def period(r: random.Random) -> str:
    month = lambda: f"{r.choice(MONTHS)}{r.choice((' ', '  '))}{r.randrange(1985, 2030)}"
    kind = r.randrange(7)
    dash = r.choice((" - ", "-", " – ", "—", "- "))
    return (
        f"{month()}{dash}{month()}", f"{month()}{dash}{r.choice(ENDS)}", f"{r.randrange(1970, 2040)}{dash}{r.randrange(1985, 2040)}", f"{r.randrange(1985, 2040)}{dash}Present",
        f"{r.randrange(100)}{r.choice(('', ' '))}{r.choice(('months', 'mos', 'yrs', 'year', 'motors'))}", f"{month()}", "99999999999 years",
    )[kind]


def line(r: random.Random) -> str:
    kind = r.randrange(12)
    heads = [w for words in R.SECTION_KEYWORDS.values() for w in words]
    if kind == 0:
        return r.choice(("", " ", "\t"))
    if kind == 1:
        return r.choice(("", "== ", "** ")) + r.choice((str, str.title, str.upper))(r.choice(heads)) + r.choice(("", ":", " :", " ==", ".", " and more words that make it far too long to be any heading at all"))
    if kind in (2, 3):
        return r.choice(("", "Lead, ", "- ")) + period(r) + r.choice(("", ", Berlin"))
    if kind == 4:
        return f"2019 {r.choice(('-', ''))}"
    return r.choice(("- ", "• ", "", "  * ")) + r.choice(("built things", "Engineer", "team of 5 people", "x" * 200, "ünï", "Manager at Foo, Inc.", "-"))


def record(r: random.Random) -> str:
    return "\n".join(line(r) for _ in range(r.randrange(0, 30)))


def test_roles_equal_the_plain_parser(spark):
    r = random.Random(1)
    texts = [record(r) for _ in range(1000)] + ["", "\n", "a\n2019 -\n2020\nb", "2019 -\n2020, 2021 –\nPresent", "\n".join(f"Role {k}\nJan {1990 + k % 30} - Mar 2022\n- did" for k in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(8)
    got = {x["k"]: x["w"] for x in df.select("k", roles(F.col("text"), AS_OF).alias("w")).collect()}
    dated = 0
    for k, text in enumerate(texts):
        want, total, warnings = roles_of(text, AS_OF)
        huge = [x for x in want if x["duration_months"] >= 2**31]
        for x in huge:  # months that no int holds count as none
            total -= x["duration_months"]
            x["duration_months"] = 0
        assert not warnings and ([x.asDict() for x in got[k]["roles"]], got[k]["total"]) == (want, total), (text, want)
        dated += len(want)
    assert dated > 2000


def test_sections_equal_the_plain_parser(spark):
    r = random.Random(2)
    texts = [record(r) for _ in range(1000)] + ["", "x\ny", "Skills", "Skills:\na\n\nEducation", "profile summary about\n\n\nSkills\n", "skills\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(8)
    got = {x["k"]: x["s"] for x in df.select("k", sections(F.col("text")).alias("s")).collect()}
    assert got == {k: sections_of(t) for k, t in enumerate(texts)}


def test_a_large_taxonomy_parses_like_a_small_one(spark):
    r = random.Random(3)
    names = ["Python", "Node.js", "C++", "Machine Learning", "Go"]
    texts = [record(r) + "\n" + " ".join(r.choice(names) for _ in range(3)) + r.choice(("", "\nSkills\nGo, C++, python", "\nSkills\n")) for _ in range(100)] + [None, " "]
    df = spark.createDataFrame([(f"c{k}", t) for k, t in enumerate(texts)], "candidate_id string, text string")
    small = Taxonomy({"technical": names[:3], "tools": names[3:]})
    large = Taxonomy({"technical": [*names[:3], *(f"absent{k}" for k in range(600))], "tools": names[3:]})
    a, b = (sorted(parse_texts(df, t, AS_OF).collect(), key=lambda x: x["candidate_id"]) for t in (small, large))
    assert len(a) == 100 and a == b and len({str(x["sections"]["skills"]) for x in a}) > 5
