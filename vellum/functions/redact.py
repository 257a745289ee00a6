"""Redaction of personal data: ordered steps over a text column and the vault columns beside it.

Every step is DataFrame -> DataFrame, reads the text that the step before left, and is built of JVM expressions. State
columns: text, original_name, counts (map), contacts (struct of arrays), publications, techniques. The NER step takes an
injected tagger; without one it is skipped, which is a mode of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import patterns as R
from vellum.functions.text import chain, find_all, folded, has_any, let, may_match, replace_each, strip, strip_whole, sub
from vellum.schemas import CONTACTS, SPAN, VALIDATION

Step = Callable[[DataFrame], DataFrame]
Tagger = Callable[[str], Iterable[tuple[int, int, str]]]
LEVELS = ("STRICT", "MODERATE", "MINIMAL")
_NONE = "array<string>"


def _tag() -> Column:
    return F.concat(F.lit("["), F.col("candidate_id"), F.lit("]"))


def _count(name: str, n: Column) -> Column:
    """counts with one more entry where n is positive."""
    return F.when(n > 0, F.map_concat("counts", F.create_map(F.lit(name), n.cast("int")))).otherwise(F.col("counts"))


def _used(name: str, when: Column) -> Column:
    return F.when(when, F.array_append("techniques", F.lit(name))).otherwise(F.col("techniques"))


def _may(name: str) -> Column:
    """Whether the pattern of that name may match the text: a look for what it needs, far cheaper than the pattern."""
    return may_match(F.col("_folded"), R.NEEDS.get(name, ()), R.NEEDS_MATCH.get(name))


def _put(df: DataFrame, may: Column, text: Callable[[Column], Column], **more: Column) -> DataFrame:
    """text becomes text(text) where it may differ; _folded, the folded text, follows. more: columns made beside it, from the text before."""
    df = df.withColumn("_may", may)
    df = df.withColumns({"text": F.when(F.col("_may"), text(F.col("text"))).otherwise(F.col("text")), **more})
    return df.withColumn("_folded", F.when(F.col("_may"), folded(F.col("text"))).otherwise(F.col("_folded"))).drop("_may")


def _where(may: Column, text: Callable[[Column], Column]) -> Column:
    """text(text) where it may differ from the text."""
    return F.when(may, text(F.col("text"))).otherwise(F.col("text"))


def _ready(df: DataFrame) -> DataFrame:
    return df if "_folded" in df.columns else df.withColumn("_folded", folded(F.col("text")))


def start(df: DataFrame) -> DataFrame:
    """State columns beside candidate_id and text; null text counts as empty."""
    contacts = F.struct(*(F.array().cast(_NONE).alias(c) for c in CONTACTS))
    return df.withColumns(
        {
            "text": F.coalesce("text", F.lit("")),
            "original_name": F.lit(None).cast("string"),
            "contacts": contacts,
            "publications": F.array().cast(_NONE),
            "counts": F.create_map().cast("map<string,int>"),
            "techniques": F.array().cast(_NONE),
        }
    )


def redact_name(df: DataFrame) -> DataFrame:
    """The first line, if it reads like a name, becomes [candidate_id] everywhere, as does its form in capitals."""
    line = strip(F.regexp_extract("text", r"(?U)\A\s*+([^\n]*+)", 1))
    words = F.size(F.split(line, r"(?U)\s+"))
    name = (line != "") & (F.length(line) < 60) & ~line.rlike(r"[@|:;/\\#]") & ~F.upper(line).isin(*R.HEADER_TITLES) & words.between(2, 5) & line.rlike(r"(?U)^[A-Za-z\s.\-]+$")
    df = df.withColumn("original_name", F.when(name, line))
    once = F.replace("text", F.col("original_name"), _tag())
    return _put(_ready(df), F.col("original_name").isNotNull(), lambda t: F.replace(once, F.upper("original_name"), _tag()))


def _contact(name: str, pattern: str, tag: str, *, group: int = 0, literal: bool = True, keep: Callable[[Column], Column] | None = None, may: Callable[[], Column]) -> Step:
    """Matches go to the vault and are counted; the text has tag in their place, by literal or by pattern. may: whether there may be any."""

    def step(df: DataFrame) -> DataFrame:
        df = _ready(df)
        hits = F.when(may(), find_all(F.col("text"), pattern, group)).otherwise(F.array().cast(_NONE))
        df = df.withColumn("hits", hits)
        df = df.withColumn("found", F.filter(F.transform("hits", strip) if group == 0 else F.col("hits"), keep) if keep else F.col("hits"))
        more = {"contacts": F.col("contacts").withField(name, F.col("found")), "counts": _count(name, F.size("found"))}
        return _put(df, F.size("hits") > 0, lambda t: replace_each(t, F.col("found"), tag) if literal else sub(t, pattern, tag), **more).drop("found", "hits")

    return step


def is_phone(p: Column) -> Column:
    """10 to 15 digits and no decimal point between digits."""
    return F.length(sub(p, R.P + r"\D", "")).between(10, 15) & ~p.rlike(R.DECIMAL)


def has_at() -> Column:
    return F.contains("text", F.lit("@"))


def has_digits() -> Column:
    return F.col("text").rlike(r"(?U)\d{3}")


redact_email = _contact("emails", R.EMAIL, "[EMAIL_REDACTED]", may=has_at)
redact_phone = _contact("phones", R.PHONE, "[PHONE_REDACTED]", keep=is_phone, may=has_digits)
redact_linkedin = _contact("linkedin", R.LINKEDIN, "[LINKEDIN_REDACTED]", may=lambda: _may("LINKEDIN"))
redact_handles = _contact("linkedin_handles", R.LINKEDIN_HANDLE, "[LINKEDIN_REDACTED]", group=1, literal=False, may=lambda: _may("LINKEDIN_HANDLE"))
redact_github = _contact("github", R.GITHUB, "[URL_REDACTED]", group=1, literal=False, may=lambda: _may("GITHUB"))
redact_urls = _contact("urls", R.URL, "[URL_REDACTED]", may=lambda: _may("URL"))
redact_bare_urls = _contact("urls_no_proto", R.URL_NO_PROTO, "[URL_REDACTED]", group=1, literal=False, may=lambda: _may("URL_NO_PROTO"))
redact_addresses = _contact("addresses", R.ADDRESS, "[ADDRESS_REDACTED]", group=1, keep=lambda a: a != "", may=lambda: F.col("text").rlike(r"(?U)\d\s"))


def mark_contacts(df: DataFrame) -> DataFrame:
    return df.withColumn("techniques", F.array_append("techniques", F.lit("contact_regex")))


def redact_linkedin_paths(df: DataFrame) -> DataFrame:
    return _put(_ready(df), _may("LINKEDIN_PATH"), lambda t: sub(t, R.LINKEDIN_PATH, "[LINKEDIN_REDACTED]"))


def remove_birth(df: DataFrame) -> DataFrame:
    """Dates of birth, then ages; ages have no word boundary (page 12 loses its end too)."""
    df = _put(_ready(df), _may("DOB"), lambda t: sub(t, R.DOB, "[DOB_REDACTED]"))
    return _put(df, _may("AGE"), lambda t: sub(t, R.AGE, ""))


def replace_proxies(df: DataFrame) -> DataFrame:
    """Names of groups that stand for identity become neutral ones, in order."""
    greek = next(k for k, (pattern, _) in enumerate(R.PROXIES) if R.GREEK in pattern)
    df = _ready(df)
    for need, pairs in (("PROXIES", R.PROXIES[:greek]), ("GREEK", R.PROXIES[greek : greek + 1]), ("LATE_PROXIES", R.PROXIES[greek + 1 :])):
        df = _put(df, _may(need), lambda t, pairs=pairs: chain(t, pairs, R.I))
    return df


def redact_passing_years(df: DataFrame) -> DataFrame:
    return _put(_ready(df), _may("PASSING_YEAR"), lambda t: sub(t, R.PASSING_YEAR, "[YEAR_REDACTED]"))


#: (digits of the number of years, phrase): the whole run of digits decides.
YEAR_BANDS = (("[0-2]", "Early career experience"), ("[3-7]", "Professional experience"), ("(?:[89]|1[0-5])", "Extensive experience"), (r"\d+", "Significant experience"))


def bucket_experience(df: DataFrame) -> DataFrame:
    """`N years experience` becomes a phrase for its band, so that it gives no age away."""
    rest = R.EXPERIENCE_YEARS.removeprefix(r"(\d+)")
    n = F.when(_may("EXPERIENCE_YEARS"), F.regexp_count("text", F.lit(R.I + R.EXPERIENCE_YEARS))).otherwise(0)
    some = F.col("found") > 0
    text = lambda t: reduce(lambda t, band: sub(t, rf"{R.I}(?<!\d)0*{band[0]}(?!\d){rest}", band[1]), YEAR_BANDS, t)
    return _put(_ready(df).withColumn("found", n), some, text, counts=_count("experience_duration", F.col("found")), techniques=_used("experience_duration", some)).drop("found")


def redact_publications(df: DataFrame) -> DataFrame:
    """Publications go to the vault; in the text they lose their co-authors."""
    df = _ready(df).withColumn("found", F.when(_may("PUBLICATION"), find_all(F.col("text"), R.PUBLICATION)).otherwise(F.array().cast(_NONE)))
    n = F.size("found")
    more = {"publications": F.concat("publications", "found"), "counts": _count("publications", n), "techniques": _used("publication_redaction", n > 0)}
    return _put(df, n > 0, lambda t: sub(t, R.PUBLICATION, "$1"), **more).drop("found")


def has_date(text: Column) -> Column:
    return text.rlike(r"(?U)\d[/\-.]\d")


def redact_dates(df: DataFrame) -> DataFrame:
    """Dates with a day; month and year stay."""
    full, named = F.col("full"), F.col("named")
    df = _ready(df).withColumn("full", F.when(has_date(F.col("text")), F.regexp_count("text", F.lit(R.FULL_DATE))).otherwise(0))
    df = _put(df, full > 0, lambda t: sub(t, R.FULL_DATE, "[DATE_REDACTED]"))
    df = df.withColumn("named", F.when(_may("NAMED_DATE"), F.regexp_count("text", F.lit(R.NAMED_DATE))).otherwise(0))
    more = {"counts": _count("full_dates", full + named), "techniques": _used("full_date_redaction", full + named > 0)}
    return _put(df, named > 0, lambda t: sub(t, R.NAMED_DATE, "[DATE_REDACTED]"), **more).drop("full", "named")


def redact_schools(df: DataFrame) -> DataFrame:
    tag = "[Educational Institution]"
    return _put(_ready(df), _may("SCHOOL_WORD"), lambda t: sub(sub(t, R.SCHOOL, tag), R.GENERIC_SCHOOL, tag))


def redact_degree_places(df: DataFrame) -> DataFrame:
    """What follows `degree from`, `at` or `in`."""
    some = F.col("found") > 0
    df = _ready(df).withColumn("found", F.when(_may("DEGREE_CONTEXT"), F.regexp_count("text", F.lit(R.DEGREE_CONTEXT))).otherwise(0))
    more = {"counts": _count("degree_institutions", F.col("found")), "techniques": _used("degree_context", some)}
    return _put(df, some, lambda t: sub(t, R.DEGREE_CONTEXT, "$1[Educational Institution]"), **more).drop("found")


def redact_education_places(df: DataFrame) -> DataFrame:
    return _put(_ready(df), _may("EDUCATION_LINE"), lambda t: sub(t, R.EDUCATION_LINE, "$1, [LOCATION_REDACTED]$3"))


def resolve_spans(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that don't overlap: by start, the longer first; one that begins inside the last kept is dropped."""
    kept: list[tuple[int, int, str]] = []
    for span in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
        if not kept or span[0] >= kept[-1][1]:
            kept.append(span)
    return kept


def entity_replacement(text: str, start: int, end: int, label: str, candidate_id: str, level: str) -> str | None:
    """What an entity becomes, None if it stays."""
    import re

    said = text[start:end]
    low = said.lower().strip()
    if label == "PERSON":
        return None if low in R.TECH_WORDS or {w for w in re.split(r"[\s,/\\]+", low) if w} & set(R.TECH_WORDS) else f"[{candidate_id}]"
    if level == "MINIMAL":
        return None
    if label == "ORG":
        return "[Educational Institution]" if any(w in said.lower() for w in R.EDUCATION_WORDS) else None
    if label == "DATE":
        keeps = not re.search(r"\b(19|20)\d{2}\b", said) or re.search(r"(present|current|to|–|-)", said, re.I)
        month = re.match(rf"^(?:{R._MON}|Q[1-4])\s+\d{{4}}$", said.strip(), re.I)
        near = text[max(0, start - 80) : start].lower()
        return None if keeps or month or any(w in near for w in R.DATE_CONTEXT) else ""
    if label in ("GPE", "LOC"):
        inside = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
        known = low in R.PLACE_WORDS or low in R.TECH_WORDS or (level == "MODERATE" and low in R.COUNTRIES)
        return None if inside or known else "[LOCATION_REDACTED]"
    if label == "NORP":
        return None if low.rstrip("+#") in R.NATIONAL_WORDS or said.strip() in ("C", "C++", "C#", "R") else "[REDACTED]"
    return None


def redact_entities(tagger: Callable[[], Tagger] | None, level: str) -> Step:
    """Named entities. tagger: makes, in the worker, a function from a text to (start, end, label); None skips the step."""
    if tagger is None:
        return lambda df: df

    def plan(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tag = tagger()
        for texts, ids in batches:
            out = []
            for text, cid in zip(texts, ids, strict=True):
                found = [(a, b, label, entity_replacement(text, a, b, label, cid, level)) for a, b, label in tag(text)]
                spans = resolve_spans([(a, b, r) for a, b, _, r in found if r is not None])
                persons = [text[a:b] for a, b, label, r in found if label == "PERSON" and r is not None]
                done, last = [], 0
                for a, b, r in spans:
                    done += [text[last:a], r]
                    last = b
                out.append({"text": "".join(done) + text[last:], "persons": persons, "spans": [{"start": a, "end": b, "repl": r} for a, b, r in spans]})
            yield pd.DataFrame(out)

    udf = F.pandas_udf(plan, f"struct<text:string,persons:array<string>,spans:array<{SPAN}>>")

    def step(df: DataFrame) -> DataFrame:
        df = df.withColumn("ner", udf("text", "candidate_id"))
        return df.withColumns({"text": F.col("ner.text"), "original_name": F.coalesce("original_name", F.get("ner.persons", F.lit(0))), "counts": _count("ner_persons", F.size("ner.persons")), "techniques": F.array_append("techniques", F.lit("spacy_ner"))}).drop("ner", "_folded")

    return step


def redact_heuristic_names(df: DataFrame) -> DataFrame:
    """2 to 4 capitalised words after a comma, semicolon, colon or dash; the longest are replaced first, then by alphabet."""
    white = sorted({*R.TECH_WORDS, *R.PLACE_WORDS, *(t.lower() for t in R.HEADER_TITLES)})
    known = F.coalesce(F.lower("original_name"), F.lit(""))
    fits = lambda n: ~F.arrays_overlap(F.split(F.lower(n), r"(?U)\s+"), F.array(*map(F.lit, white))) & (F.lower(n) != known) & ~F.upper(n).isin(*R.HEADER_TITLES)
    order = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    names = F.array_sort(F.filter(F.array_distinct(find_all(F.col("text"), R.HEURISTIC_NAME, 1)), fits), order)
    df = df.withColumn("found", names)
    return df.withColumns({"text": replace_each(F.col("text"), F.col("found"), _tag()), "counts": _count("heuristic_names", F.size("found")), "techniques": _used("heuristic_name_detection", F.size("found") > 0)}).drop("found", "_folded")


def neutral_pronouns(text: Column) -> Column:
    def step(text: Column, words: tuple[str, ...], pattern: str, to: str) -> Column:
        return let(text, lambda t: F.when(has_any(t, words), sub(t, pattern, to)).otherwise(t))

    return reduce(lambda t, x: step(t, *x), (*((w, R.P + p, to) for w, p, to in R.PRONOUN_WORDS), (("  ",), "  +", " ")), text)


def neutralize_pronouns(df: DataFrame) -> DataFrame:
    return df.withColumn("text", neutral_pronouns(F.col("text"))).drop("_folded")


def clean_up(df: DataFrame) -> DataFrame:
    """Left-over fragments: St. names, doubled tags, cities at the start of the first five lines, education years, places
    on company lines, and a name on the last line of a text whose first line was one."""
    tag, said, text = r"\[Educational Institution\]", "[Educational Institution]", F.col("text")
    df = df.withColumn("text", _where(F.contains(text, F.lit("St")), lambda t: sub(t, R.ST_PREFIX, said + " ")))
    doubled = lambda t: sub(sub(t, rf"{R.P}{tag}\s*'?s?\s*{tag}", said), rf"{R.P}{tag}\s*'s\s*", said + " ")
    df = df.withColumn("text", _where(F.contains(text, F.lit(said)), doubled))
    city = lambda line: F.lower(F.regexp_extract(line, R.ADDRESS_CITY, 1))
    fits = lambda line: line.rlike(R.ADDRESS_CITY) & ~city(line).isin(*R.PLACE_WORDS, *R.TECH_WORDS)
    placed = lambda lines: F.transform(lines, lambda line, k: F.when((k < 5) & fits(line), sub(line, R.ADDRESS_CITY, "[LOCATION_REDACTED]")).otherwise(line))
    df = df.withColumn("text", _where(F.contains(text, F.lit(",")), lambda t: F.array_join(placed(F.split(t, "\n", 6)), "\n")))
    # The year's range, if any, is told by what stands between two marks.
    marked = lambda t: sub(sub(sub(t, R.EDUCATION_YEAR, "$1\x01$3\x02"), "\x01[0-9]+\x02", ", [YEAR_REDACTED]"), "\x01\x02", "")
    df = df.withColumn("text", _where(text.rlike(r"(?U)(?:19|20)\d{2}") | F.contains(text, F.lit("\x01")), marked))
    df = df.withColumn("text", _where(has_any(text, ("Networks", "Pvt", "Ltd", "Inc", "Corp")), lambda t: sub(t, R.COMPANY_LINE, "$1, [LOCATION_REDACTED]")))
    ending = F.when(F.col("original_name").isNotNull(), strip(F.element_at(F.split(strip(text), "\n", -1), -1)))
    df, last = df.withColumn("last", ending), F.col("last")
    fits_ = last.isNotNull() & (last != "") & (F.length(last) < 50) & ~last.rlike(r"[@|:;/\\#\[\]]") & last.rlike(r"(?U)^[A-Za-z\s.]+$") & (F.size(F.split(last, r"(?U)\s+")) <= 5)
    df = df.withColumn("last", F.when(fits_, last))
    # The last occurrence: the text's end, reversed.
    back = F.length("text") - F.instr(F.reverse("text"), F.reverse("last")) - F.length("last") + 1
    swapped = F.concat(F.substring("text", F.lit(1), back), _tag(), F.substring("text", back + F.length("last") + 1, F.length("text")))
    return df.withColumn("text", F.when(F.col("last").isNull(), F.col("text")).otherwise(swapped)).drop("last", "_folded")


def tidy(df: DataFrame) -> DataFrame:
    df = df.withColumn("text", _where(F.contains("text", F.lit("\n\n\n")), lambda t: sub(t, r"\n{3,}", "\n\n")))
    return df.withColumn("text", strip_whole(_where(F.contains("text", F.lit("  ")), lambda t: sub(t, "  +", " ")))).drop("_folded")


def leaks_of(text: Column) -> Column:
    """array of (type, matches): what still looks personal."""
    some = lambda may, pattern: F.when(may, find_all(text, pattern)).otherwise(F.array().cast(_NONE))
    phones = F.filter(some(text.rlike(r"(?U)\d{3}"), R.PHONE), lambda p: F.length(sub(p, R.P + r"\D", "")).between(10, 15))
    urls = F.filter(some(may_match(folded(text), R.NEEDS["URL"]), R.URL), lambda u: ~u.contains("REDACTED"))
    names = F.filter(find_all(text, R.NAME_CHECK, 1), lambda n: ~n.isin(*R.SAFE_NAMES))
    leak = lambda kind, found, least=0, most=None: let(found, lambda f: F.when(F.size(f) > least, F.struct(F.lit(kind).alias("type"), (F.slice(f, 1, most) if most else f).alias("matches"))))
    each = (("email", some(F.contains(text, F.lit("@")), R.EMAIL)), ("phone", phones), ("url", urls), ("full_date", some(has_date(text), R.FULL_DATE)), ("potential_names", names, 3, 5))
    return F.array_compact(F.array(*(leak(*x) for x in each)))


def validate(text: Column) -> Column:
    """VALIDATION: passed, leaks_found, confidence_score (100 less 15 for each type of leak)."""
    made = lambda leaks: F.struct((F.size(leaks) == 0).alias("passed"), leaks.alias("leaks_found"), F.greatest(F.lit(0.0), F.lit(100.0) - 15.0 * F.size(leaks)).alias("confidence_score"))
    return F.transform(F.array(leaks_of(text)), made)[0].cast(VALIDATION)


def steps(level: str = "STRICT", tagger: Callable[[], Tagger] | None = None) -> list[tuple[str, Step]]:
    """All steps in order; the order is part of their meaning. Unknown levels count as STRICT."""
    level = level.upper() if level.upper() in LEVELS else "STRICT"
    return [
        ("name", redact_name), ("email", redact_email), ("phone", redact_phone), ("mark_contacts", mark_contacts), ("linkedin", redact_linkedin),
        ("linkedin_paths", redact_linkedin_paths), ("handles", redact_handles), ("github", redact_github), ("urls", redact_urls),
        ("bare_urls", redact_bare_urls), ("addresses", redact_addresses), ("birth", remove_birth), ("proxies", replace_proxies),
        ("passing_years", redact_passing_years), ("experience", bucket_experience), ("publications", redact_publications), ("dates", redact_dates),
        ("schools", redact_schools), ("degree_places", redact_degree_places), ("education_places", redact_education_places),
        ("entities", redact_entities(tagger, level)), ("heuristic_names", redact_heuristic_names), ("pronouns", neutralize_pronouns),
        ("clean_up", clean_up), ("tidy", tidy),
    ]


def anonymize(df: DataFrame, level: str = "STRICT", tagger: Callable[[], Tagger] | None = None) -> DataFrame:
    """candidate_id, text (redacted) and the vault's columns, from candidate_id and text; further columns stay."""
    level = level.upper() if level.upper() in LEVELS else "STRICT"
    out = reduce(lambda d, step: step[1](d), steps(level, tagger), start(df))
    return out.withColumns({"anonymization_level_used": F.lit(level), "validation_score": validate(F.col("text"))}).withColumnsRenamed({"contacts": "contact_info", "counts": "pii_categories_found", "techniques": "techniques_applied"})
