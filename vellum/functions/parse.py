"""Parsing of redacted texts into sections, skills, experience, education, certifications, languages and a quality score."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import patterns as R
from vellum.functions.taxonomy import CV_GUARD, Taxonomy, languages, match_table, skills_map
from vellum.functions.text import compact, find_all, is_blank, strip, strip_whole, sub
from vellum.schemas import EDUCATION, ROLE
from vellum.session import checkpointed


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _starts(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a | c.startswith(w), words, F.lit(False))


def sections(text: Column) -> Column:
    """Map of the sections found and their contents; without any heading the whole text is the summary.

    A heading has 2 to 60 characters, no final . or , and a keyword in front. A section runs from its first heading to the
    next section's. Its heading line goes, unless it is all there is.
    """

    def bare(line: Column) -> Column:
        shaped = lambda own: (F.length(own) >= 2) & (F.length(own) <= 60) & ~own.rlike(r"[.,]$")
        said = lambda own: sub(strip(sub(F.lower(own), ":+$", "")), r"(?U)^[-=_*#\s]+|[-=_*#\s]+$", "")
        return _let(strip_whole(line), lambda own: F.when(shaped(own), said(own)))

    def cut(lines: Column, heads: Column) -> Column:
        at = [F.struct(F.array_position(F.transform(heads, lambda h: F.coalesce(_starts(h, words), F.lit(False))), F.lit(True)).cast("int").alias("at"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, words) in enumerate(R.SECTION_KEYWORDS.items())]
        first = F.array_sort(F.filter(F.array(*at), lambda x: x["at"] > 0))

        def body(found: Column, x: Column, i: Column) -> Column:
            end = F.coalesce(F.get(found, i + 1)["at"], F.size(lines) + 1)
            return strip(F.array_join(F.slice(lines, x["at"], end - x["at"]), "\n"))

        content = lambda b: F.when(F.locate("\n", b) > 0, strip(F.substring(b, F.locate("\n", b) + 1, F.length(b)))).otherwise(b)
        told = lambda found: F.transform(found, lambda x, i: F.struct(x["name"].alias("key"), _let(body(found, x, i), content).alias("value")))
        return _let(first, lambda found: F.when(F.size(found) > 0, F.map_from_entries(told(found))).otherwise(F.create_map(F.lit("summary"), text)))

    return _let(F.split(text, "\n"), lambda lines: _let(F.transform(lines, bare), lambda heads: cut(lines, heads)))


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_HEADINGS = tuple(dict.fromkeys(k for words in R.SECTION_KEYWORDS.values() for k in words))
_FLAGS = "(?iU)"


def month_number(said: Column, as_of: date) -> Column:
    """Months since year 0 of `Jan 2022`, `2022` (January) or a word for now."""
    year = F.regexp_extract(said, r"([0-9]{4})\s*$", 1).try_cast("int")
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.substring(said, 1, 3)))
    return F.when(year.isNull(), F.lit(as_of.year * 12 + as_of.month)).otherwise(year * 12 + F.when(month > 0, month.cast("int")).otherwise(1))


def span(line: Column, as_of: date) -> Column:
    """struct (period, months) of a line: a month range, else a year range, else a stated duration; both null without any.

    `6 mos` is 72 months and `5 motors` 60, since only units that begin with `mon` count as months. A unit that touches
    its number is read like any other. A number that no int holds gives no months.
    """
    part = lambda pattern, k: F.regexp_extract(line, _FLAGS + pattern, k)
    between = lambda pattern: F.greatest(month_number(part(pattern, 2), as_of) - month_number(part(pattern, 1), as_of), F.lit(0))
    stated = part(R.DURATION, 1).try_cast("int").cast("long") * F.when(F.lower(part(R.DURATION, 2)).startswith("mon"), 1).otherwise(12)
    known = [(p, between(p)) for p in (R.DATE_RANGE, R.YEAR_RANGE)] + [(R.DURATION, F.when(stated < 2**31, stated.cast("int")))]
    pick = lambda of: reduce(lambda rest, k: F.when(line.rlike(_FLAGS + k[0]), of(k)).otherwise(rest), reversed(known), F.lit(None))
    return F.struct(pick(lambda k: part(k[0], 0)).cast("string").alias("period"), pick(lambda k: k[1]).cast("int").alias("months"))


def _role(period: Column, months: Column, said: Column) -> Column:
    return F.struct(F.lit("[REDACTED]").alias("title"), F.coalesce(months, F.lit(0)).cast("int").alias("duration_months"), F.coalesce(period, F.lit("")).alias("period"), said.alias("description")).cast(ROLE)


def roles(section: Column, as_of: date) -> Column:
    """struct (roles, total) of an experience section: a fold over its lines, with one line of lookahead.

    A line with a period, or followed by a line with one, opens a role; lines up to the next line with a period or the
    next heading describe it. Overlapping roles count twice. Without any role, year ranges anywhere in the text do.
    """
    state = f"struct<roles:array<{ROLE}>,total:bigint,open:boolean,skip:boolean,period:string,months:int,about:string>"

    def clean(line: Column) -> Column:
        return strip(sub(line, "(?U)" + R.BULLET, ""))

    def closed(s: Column) -> Column:
        return F.when(s["open"], F.concat(s["roles"], F.array(_role(s["period"], s["months"], F.substring(s["about"], 1, 500))))).otherwise(s["roles"])

    def step(s: Column, x: Column) -> Column:
        blank = x["line"] == ""
        stays = s["open"] & (blank | (x["period"].isNull() & ~x["heading"]))
        opens = ~blank & (x["period"].isNotNull() | x["next_period"].isNotNull())
        own = x["period"].isNotNull()
        months = F.when(own, x["months"]).otherwise(x["next_months"])
        more = F.when(F.length(s["about"]) >= 500, s["about"]).otherwise(strip(F.concat_ws(" ", s["about"], clean(x["line"]))))
        pick = lambda name, staying, other: F.when(s["skip"], s[name]).when(stays, staying).otherwise(other).alias(name)
        return F.struct(
            pick("roles", s["roles"], closed(s)),
            pick("total", s["total"], s["total"] + F.when(opens, F.coalesce(months, F.lit(0))).otherwise(0)),
            pick("open", s["open"], opens),
            F.when(s["skip"] | stays, F.lit(False)).otherwise(opens & ~own).alias("skip"),
            pick("period", s["period"], F.when(own, x["period"]).otherwise(x["next_period"])),
            pick("months", s["months"], months),
            pick("about", more, clean(x["line"])),
        ).cast(state)

    def fold(told: Column) -> Column:
        ahead = F.transform(told, lambda x, i: F.struct(x["line"].alias("line"), x["s"]["period"].alias("period"), x["s"]["months"].alias("months"), F.get(told, i + 1)["s"]["period"].alias("next_period"), F.get(told, i + 1)["s"]["months"].alias("next_months"), sub(F.lower(x["line"]), ":+$", "").isin(*_HEADINGS).alias("heading")))
        none = F.struct(F.array().cast(f"array<{ROLE}>").alias("roles"), F.lit(0).cast("long").alias("total"), F.lit(False).alias("open"), F.lit(False).alias("skip"), F.lit(None).cast("string").alias("period"), F.lit(None).cast("int").alias("months"), F.lit("").alias("about")).cast(state)
        return F.aggregate(ahead, none, step, lambda s: F.struct(closed(s).alias("roles"), s["total"].alias("total")))

    def years(found: Column) -> Column:
        each = F.transform(find_all(section, _FLAGS + R.YEAR_RANGE), lambda m: _role(m, span(m, as_of)["months"], F.lit("")))
        total = lambda e: F.struct(e.alias("roles"), F.aggregate(e, F.lit(0).cast("long"), lambda a, r: a + r["duration_months"]).alias("total"))
        return F.when(F.size(found["roles"]) > 0, found).otherwise(_let(each, total))

    lines = F.transform(F.split(section, "\n"), lambda x: _let(strip(x), lambda y: F.struct(y.alias("line"), span(y, as_of).alias("s"))))
    return _let(_let(lines, fold), years)


def education(section: Column) -> Column:
    """Entries of an education section: blocks between blank lines with a degree, a field or a year."""
    blocks = F.transform(F.split(section, r"(?U)\n\s*\n"), lambda b: strip(F.array_join(F.filter(F.transform(F.split(b, "\n"), strip), lambda x: x != ""), " ")))
    field = rf"{R.I}\b({'|'.join(R.FIELDS)})\b"
    years = R.I + R.YEAR_RANGE

    def entry(block: Column) -> Column:
        low = F.lower(block)
        level = reduce(lambda rest, d: F.when(F.contains(low, F.lit(d[0])), d[1]).otherwise(rest), reversed(R.DEGREE_LEVELS), F.lit(""))
        only = F.element_at(F.concat(F.array(F.lit("")), find_all(block, R.P + r"\b((?:19|20)\d{2})\b", 1)), -1)
        span = F.regexp_extract(block, years, 0)
        return F.struct(level.alias("level"), F.regexp_extract(block, field, 1).alias("field"), F.lit("[Educational Institution]").alias("institution"), F.when(span != "", span).otherwise(only).alias("period"))

    entries = F.transform(F.filter(blocks, lambda b: b != ""), entry)
    return F.filter(entries, lambda e: (e["level"] != "") | (e["field"] != "") | (e["period"] != "")).cast(f"array<{EDUCATION}>")


def certifications(section: Column) -> Column:
    """Distinct lines of more than 3 characters, without bullets."""
    lines = F.transform(F.split(section, "\n"), lambda x: strip(sub(x, "(?U)" + R.BULLET, "")))
    return F.array_distinct(F.filter(lines, lambda x: F.length(x) > 3))


def quality_score(s: Column) -> Column:
    """0 to 1, from a SECTIONS struct: completeness, depth of skills, experience, education, certifications.

    The skills map always has its categories, so skills always count as there.
    """
    n = F.size(F.flatten(F.map_values(s["skills"])))
    add = lambda when, weight: F.when(when, F.lit(weight)).otherwise(F.lit(0.0))
    parts = [
        add(s["summary"] != "", 0.08),
        add(F.size(s["skills"]) > 0, 0.15),
        add(F.size(s["experience"]) > 0, 0.15),
        add(F.size(s["education"]) > 0, 0.08),
        add(F.size(s["certifications"]) > 0, 0.02),
        add(F.size(s["languages"]) > 0, 0.02),
        F.when(n >= 15, 0.20).when(n >= 8, 0.12).when(n >= 3, 0.06).otherwise(0.0),
        add(F.exists(s["experience"], lambda r: r["duration_months"] > 0), 0.10),
        add(s["total_experience_months"] > 0, 0.05),
        add(F.exists(s["education"], lambda e: e["level"] != ""), 0.06),
        add(F.exists(s["education"], lambda e: e["field"] != ""), 0.04),
        add(F.size(s["certifications"]) > 0, 0.05),
    ]
    return F.round(F.least(reduce(lambda a, b: a + b, parts, F.lit(0.0)), F.lit(1.0)), 4)


#: Spellings of a taxonomy from which names are matched by a join.
TABLE_FROM = 500


def skills_by_id(texts: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """candidate_id, skills (as skills_map has them) of texts (candidate_id, text) with any: names matched as a table."""
    hits = match_table(texts, taxonomy.table(texts.sparkSession), CV_GUARD, "candidate_id")
    per = hits.groupBy("candidate_id").agg(F.collect_list(F.struct("category", "ord", "name")).alias("hits"))
    of = lambda c: F.transform(F.array_sort(F.transform(F.filter("hits", lambda h: h["category"] == c), lambda h: F.struct(h["ord"], h["name"]))), lambda h: h["name"])
    return per.select("candidate_id", F.create_map(*(x for c in taxonomy.names for x in (F.lit(c), of(c)))).alias("skills"))


def parse_texts(df: DataFrame, taxonomy: Taxonomy, as_of: date, blank: Callable[[Column], Column] = is_blank) -> DataFrame:
    """candidate_id, parsed_at, quality_score, parse_warnings, sections from candidate_id and text; texts that are blank(text) are left out.

    A text without skills section is searched whole. Ids are distinct. Sections and roles are expressions; a taxonomy of
    TABLE_FROM spellings or more is matched in a join.
    """
    own = df.where(~blank(F.col("text"))).select("candidate_id", "text")
    none = F.array()
    joined = len(taxonomy.spellings()) >= TABLE_FROM
    if joined:
        own = checkpointed(own.withColumn("raw", sections(F.col("text"))))
        found = skills_by_id(own.select("candidate_id", F.coalesce(F.col("raw")["skills"], "text").alias("text")), taxonomy)
        empty = F.create_map(*(x for c in taxonomy.names for x in (F.lit(c), none.cast("array<string>"))))
        own = own.join(found, "candidate_id", "left").withColumn("skills", F.coalesce("skills", empty))

    def made(raw: Column, work: Column) -> Column:
        of = lambda name: raw[name]
        told = F.struct(
            F.coalesce(of("summary"), F.lit("")).alias("summary"),
            (F.col("skills") if joined else skills_map(F.coalesce(of("skills"), F.col("text")), taxonomy)).alias("skills"),
            F.coalesce(work["roles"], none.cast(f"array<{ROLE}>")).alias("experience"),
            F.coalesce(work["total"], F.lit(0)).cast("int").alias("total_experience_months"),
            F.coalesce(education(of("education")), none.cast(f"array<{EDUCATION}>")).alias("education"),
            F.coalesce(certifications(of("certifications")), none.cast("array<string>")).alias("certifications"),
            F.coalesce(F.when(of("languages").isNotNull(), languages(of("languages"))), none.cast("array<string>")).alias("languages"),
        )
        missing = lambda name: F.when(of(name).isNull(), F.lit(f"Section not found: {name}"))
        skills = F.when(of("skills").isNull(), F.lit("Skills section not found; scanning full text"))
        warnings = compact(missing("summary"), skills, *map(missing, ("experience", "education", "certifications", "languages")))
        return F.struct(told.alias("sections"), warnings.alias("parse_warnings"))

    raw = F.col("raw") if joined else sections(F.col("text"))
    work = lambda r: F.when(r["experience"].isNotNull(), roles(r["experience"], as_of))
    own = own.select("candidate_id", _let(raw, lambda r: _let(work(r), lambda w: made(r, w))).alias("m")).select("candidate_id", "m.sections", "m.parse_warnings")
    return own.select("candidate_id", F.lit(as_of).cast("timestamp").alias("parsed_at"), quality_score(F.col("sections")).alias("quality_score"), "parse_warnings", "sections")


def parse_index(parsed: DataFrame, total: int | None = None) -> DataFrame:
    """One row: texts parsed, texts that failed (of `total`), average quality."""
    row = parsed.agg(F.count("*").alias("total_processed"), F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("average_quality"))
    return row.withColumn("total_failed", F.lit(total).cast("long") - F.col("total_processed") if total is not None else F.lit(0).cast("long"))


def index_rows(parsed: DataFrame) -> DataFrame:
    """What the index says of each candidate."""
    s = F.col("sections")
    return parsed.select("candidate_id", "quality_score", "parsed_at", s["total_experience_months"].alias("total_experience_months"), F.size(F.flatten(F.map_values(s["skills"]))).alias("skill_count"), F.size("parse_warnings").alias("warnings_count"))
