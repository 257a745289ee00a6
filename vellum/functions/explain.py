"""Verdicts, notes, strengths, gaps and recommendations as expressions over a ranking row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import patterns as R
from vellum.functions.text import compact, fixed, percent, plural

S, L = F.concat, F.lit


def graded(score: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The label of the first step that the score reaches."""
    out = F.when(score >= steps[0][0], steps[0][1])
    for least, label in steps[1:]:
        out = out.when(score >= least, label)
    return out.otherwise(last)


def verdict(score: Column, role: str = "mid") -> Column:
    t = R.VERDICTS.get(role, R.VERDICTS["mid"])
    return graded(score, [(t["strong"], "Strong Match"), (t["good"], "Good Match"), (t["partial"], "Partial Match")], "Weak Match")


def score_label(score: Column) -> Column:
    return graded(score, [(0.8, "Excellent"), (0.6, "Good"), (0.4, "Fair")], "Poor")


def years(months: Column) -> Column:
    """36 as 3 years, 18 as 1.5 years, 12 as 1 year."""
    raw = months / 12
    whole = F.when(raw == F.floor(raw), F.floor(raw).cast("string")).otherwise(fixed(F.bround(raw, 1), 1))
    return F.when(months <= 0, "0 years").otherwise(S(whole, L(" year"), F.when(whole == "1", "").otherwise("s")))


def joined(skills: Column, n: int) -> Column:
    return F.array_join(F.slice(skills, 1, n), ", ")


def highest_education(entries: Column) -> Column:
    """struct(level, field) of the entry with the highest level, the first of equals; empty strings without entries."""
    order = F.array(*map(F.lit, R.DEGREE_PRIORITY))
    place = lambda e: F.when(F.array_position(order, e["level"]) > 0, F.array_position(order, e["level"])).otherwise(len(R.DEGREE_PRIORITY) + 1)
    ranked = F.transform(entries, lambda e, k: F.struct(place(e).alias("place"), k.alias("k"), F.coalesce(e["level"], L("")).alias("level"), F.coalesce(e["field"], L("")).alias("field")))
    best = F.array_min(ranked)
    return F.struct(F.coalesce(best["level"], L("")).alias("level"), F.coalesce(best["field"], L("")).alias("field"))


def semantic_note(score: Column) -> Column:
    return graded(score, [(0.8, "CV content closely matches the job description"), (0.6, "CV content shows good alignment with the job description"), (0.4, "CV content partially overlaps with the job description")], "CV content shows weak alignment with the job description")


def keyword_note(matched: Column, total: Column) -> Column:
    n = total.cast("string")
    ending = S(n, L(" required skill"), plural(total))
    return F.when(total == 0, "No specific skills were extracted from the job description").when(matched == total, S(L("Matched all "), ending)).otherwise(S(L("Matched "), matched.cast("string"), L(" of "), ending))


def quality_note(score: Column) -> Column:
    return graded(score, [(0.8, "CV is well-structured and complete"), (0.6, "CV is reasonably structured with most sections present"), (0.4, "CV structure is adequate but some sections are sparse")], "CV may be incomplete or poorly formatted")


def headline(rank: Column, n: Column, said: Column, months: Column) -> Column:
    front = S(L("Ranked #"), rank.cast("string"), F.when(n > 1, S(L(" of "), n.cast("string"))).otherwise(""))
    seasoned = months >= 12
    rest = (
        F.when((said == "Strong Match") & seasoned, "strong skill alignment and solid experience")
        .when(said == "Strong Match", "strong skill alignment with the job requirements")
        .when((said == "Good Match") & seasoned, "good overall fit with some skill gaps")
        .when(said == "Good Match", "good overall fit, limited experience on record")
        .when(said == "Partial Match", "partial match, significant gaps in required skills")
        .otherwise("weak match, skills are largely misaligned with requirements")
    )
    return S(front, L(" — "), rest)


def skills_summary(matched: Column, total: Column, missing: Column) -> Column:
    more = F.size(missing) - 3
    named = S(joined(missing, 3), F.when(more > 0, S(L(", and "), more.cast("string"), L(" more"))).otherwise(""))
    n = S(total.cast("string"), L(" required skill"), plural(total))
    return (
        F.when(total == 0, "No specific skills were extracted from the job description to compare against.")
        .when(matched == total, S(L("Candidate has all "), n, L(".")))
        .otherwise(S(L("Candidate has "), matched.cast("string"), L(" of "), n, L(". Missing: "), named, L(".")))
    )


def experience_summary(months: Column, roles: Column, known: Column) -> Column:
    across = F.when(roles > 0, S(L("across "), roles.cast("string"), L(" role"), plural(roles))).otherwise("on record")
    return (
        F.when(~known, "Detailed experience data unavailable — parsed CV not found.")
        .when((months <= 0) & (roles == 0), "No experience entries could be extracted from this CV.")
        .when(months <= 0, "Experience section present but duration could not be determined.")
        .otherwise(S(years(months), L(" of professional experience "), across, L(".")))
    )


def education_summary(level: Column, field: Column, known: Column) -> Column:
    return (
        F.when(~known, "Detailed education data unavailable — parsed CV not found.")
        .when((level != "") & (field != ""), S(level, L(" in "), field))
        .when(level != "", S(level, L(" (field not specified)")))
        .when(field != "", S(L("Degree in "), field, L(" (level not recorded)")))
        .otherwise("Education details could not be extracted from this CV.")
    )


def strengths(keyword: Column, semantic: Column, months: Column, quality: Column, level: Column, field: Column, missing: Column) -> Column:
    complete = F.size(missing) == 0
    degree = S(L("Advanced academic qualification — "), level, F.when(field != "", S(L(" in "), field)).otherwise(""))
    return compact(
        F.when(complete, "Complete skill match — all required skills present").when(keyword >= 0.7, S(L("Strong skill match — "), percent(keyword), L(" of required skills present"))),
        F.when(semantic >= 0.7, "High semantic relevance — CV content closely matches job requirements"),
        F.when(months >= 36, S(L("Extensive experience — "), years(months), L(" in the field"))).when(months >= 12, S(L("Relevant experience — "), years(months), L(" in the field"))),
        F.when(quality >= 0.8, "Well-structured CV indicating attention to detail"),
        F.when(level.isin(*R.ADVANCED_DEGREES), degree),
    )


def gaps(missing: Column, months: Column, keyword: Column, quality: Column, known: Column) -> Column:
    more = F.size(missing) - 5
    named = F.transform(F.slice(missing, 1, 5), lambda s: S(L("Missing "), s, L(" — listed as required in JD")))
    rest = compact(
        F.when(more > 0, S(L("...and "), more.cast("string"), L(" more skill"), plural(more), L(" not found in CV"))),
        F.when(known & (months < 12), "Limited professional experience (under 1 year)"),
        F.when((F.size(missing) == 0) & (keyword < 0.3), "Low skill overlap with job requirements"),
        F.when(quality < 0.5, "CV may be incomplete or poorly structured"),
    )
    return F.concat(named, rest)


def recommendation(said: Column, strong: Column, missing: Column) -> Column:
    some = F.size(missing) > 0
    top = F.coalesce(F.get(strong, F.lit(0)), L("Strong overall profile"))
    return (
        F.when((said == "Strong Match") & some, S(L("Recommended for interview. "), top, L(". Suggest probing "), F.get(missing, F.lit(0)), L(" in the interview.")))
        .when(said == "Strong Match", S(L("Recommended for interview. "), top, L(". Candidate meets all listed requirements.")))
        .when((said == "Good Match") & some, S(L("Consider for interview. Good overall fit. May need support with "), joined(missing, 2), L(".")))
        .when(said == "Good Match", "Consider for interview. Good overall fit. Candidate meets all listed requirements.")
        .when((said == "Partial Match") & some, S(L("Review manually. Has potential but significant gaps in "), joined(missing, 3), L(".")))
        .when(said == "Partial Match", "Review manually. Has potential but no specific skill gaps identified.")
        .when(some, S(L("Not recommended at this stage. Significant skill gaps: "), joined(missing, 3), L(".")))
        .otherwise("Not recommended at this stage. Overall profile does not match the job requirements.")
    )
