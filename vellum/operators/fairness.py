"""Fairness checks over a ranking: seven rows of (check_id, label, flagged, status, note, detail as JSON)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import fixed, percent, rounded

COMPRESSION, SEMANTIC_GAP, CORRELATION, QUALITY_SPREAD, LEAST_FOR_CORRELATION = 0.10, 0.40, 0.85, 0.50, 3
S, L = F.concat, F.lit
#: Ids that a check names, at most; skill_gap_rows and the anti join have them all.
NAMED = 100


def pearson(x: Column, y: Column) -> Column:
    """Correlation; 0 where either has no variance, as ANSI division would raise."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def _result(df: DataFrame, check: str, label: str, flagged: Column, note: Column, detail: Column) -> DataFrame:
    flagged = F.coalesce(flagged, F.lit(False))
    return df.select(L(check).alias("check_id"), L(label).alias("label"), flagged.alias("flagged"), F.when(flagged, "FLAGGED").otherwise("OK").alias("status"), note.alias("note"), F.to_json(detail).alias("detail"))



def named(rows: DataFrame, *order: str) -> DataFrame:
    """One row: n, ids (candidate_id of the first NAMED rows in order) and said (the ids, and how many more there are)."""
    first = rows.select(F.struct(*order).alias("place"), "candidate_id").orderBy("place").limit(NAMED)
    ids = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "candidate_id"))), lambda x: x["candidate_id"]).alias("ids"))
    out = ids.crossJoin(rows.agg(F.count("*").alias("n")))
    more = F.when(F.col("n") > NAMED, S(L(" and "), (F.col("n") - NAMED).cast("string"), L(" more"))).otherwise("")
    return out.withColumn("said", S(F.array_join("ids", ", "), more))


def score_distribution(ranking: DataFrame) -> DataFrame:
    """min, max, mean, population deviation and spread of final scores."""
    s = F.col("final_score")
    a = ranking.agg(F.count("*").alias("n"), F.min(s).alias("lo"), F.max(s).alias("hi"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("sd"))
    r = lambda c: rounded(F.col(c) if isinstance(c, str) else c, 4)
    detail = F.struct(r("lo").alias("min"), r("hi").alias("max"), r("mean").alias("mean"), r("sd").alias("stddev"), r(F.col("hi") - F.col("lo")).alias("spread"))
    note = S(L("Final scores range "), percent(F.col("lo")), L("–"), percent(F.col("hi")), L(", mean "), percent(F.col("mean")), L(", σ="), fixed(F.col("sd"), 3), L("."))
    return _result(a, "score_distribution", "Score Distribution", L(False), F.when(F.col("n") > 0, note).otherwise("No scores available."), detail)


def score_compression(ranking: DataFrame) -> DataFrame:
    """Flagged when all scores lie within COMPRESSION."""
    a = ranking.agg(F.count("*").alias("n"), (F.max("final_score") - F.min("final_score")).alias("spread"))
    low = F.col("spread") < COMPRESSION
    rest = F.when(low, "Scores are too similar to reliably differentiate candidates. Review JD specificity or ranking weights.").otherwise("Spread is sufficient to differentiate candidates.")
    note = S(L("Score spread = "), fixed(F.col("spread"), 3), F.when(low, " (< ").otherwise(" (>= "), L(f"{COMPRESSION} threshold). "), rest)
    note = F.when(F.col("n") < 2, "Fewer than 2 candidates — compression check skipped.").otherwise(note)
    return _result(a, "score_compression", "Score Compression", (F.col("n") >= 2) & low, note, F.struct(rounded(F.col("spread"), 4).alias("spread"), L(COMPRESSION).alias("threshold")))


def skill_gap(ranking: DataFrame) -> DataFrame:
    """Flagged when candidates have no matched skill; the first NAMED by rank are named."""
    a = named(ranking.where((F.size("matched_skills") == 0) & (F.col("jd_skill_count") > 0)), "rank", "candidate_id")
    n = F.col("n")
    said = S(n.cast("string"), L(" candidate(s) matched zero JD skills: "), F.col("said"), L(". These candidates were ranked using semantic similarity only — verify that their CVs are not systematically disadvantaged by skill vocabulary."))
    return _result(a, "skill_gap_disparity", "Skill-Gap Disparity", n > 0, F.when(n > 0, said).otherwise("All candidates matched at least one JD skill."), F.struct(F.col("ids").alias("zero_match_candidates"), n.alias("zero_match_count")))


def skill_gap_rows(ranking: DataFrame) -> DataFrame:
    """Matched and missing counts of each candidate."""
    return ranking.select("candidate_id", "rank", F.size("matched_skills").alias("matched_count"), F.size("missing_skills").alias("missing_count"), "jd_skill_count")


def semantic_gap(ranking: DataFrame) -> DataFrame:
    """Flagged when the first candidate's semantic and keyword scores are far apart."""
    top = ranking.agg(F.min_by(F.struct("candidate_id", "semantic_score", "keyword_score"), F.coalesce("rank", L(2**31 - 1))).alias("t")).select("t.*")
    gap = F.abs(F.col("semantic_score") - F.col("keyword_score"))
    big = gap > SEMANTIC_GAP
    rest = F.when(big, "Large gap may indicate the top candidate scored high on contextual relevance but is missing explicit skill keywords — or vice versa. Manual review recommended.").otherwise("Semantic and keyword scores are consistent for the top candidate.")
    note = S(L("Top candidate "), F.col("candidate_id"), L(": semantic="), percent(F.col("semantic_score")), L(", keyword="), percent(F.col("keyword_score")), L(", gap="), fixed(gap, 3), L(". "), rest)
    r = lambda c: rounded(F.col(c) if isinstance(c, str) else c, 4)
    detail = F.struct(F.col("candidate_id").alias("top_candidate"), r("semantic_score").alias("semantic_score"), r("keyword_score").alias("keyword_score"), r(gap).alias("gap"), L(SEMANTIC_GAP).alias("threshold"))
    return _result(top, "semantic_keyword_gap", "Semantic vs Keyword Gap", big, F.coalesce(note, L("No candidates — check skipped.")), detail)


def experience_correlation(ranking: DataFrame, months: DataFrame) -> DataFrame:
    """Flagged when experience (candidate_id, total_experience_months) and rank correlate strongly, either way."""
    both = ranking.where("rank > 0").join(months, "candidate_id")
    a = both.agg(F.count("*").alias("n"), pearson(F.col("total_experience_months").cast("double"), F.col("rank").cast("double")).alias("r"))
    size, strong = F.abs("r"), (F.col("n") >= LEAST_FOR_CORRELATION) & (F.abs("r") > CORRELATION)
    way = F.when(F.col("r") < 0, "higher").otherwise("lower")
    rest = F.when(strong, S(L("Strong correlation detected: more experience → "), way, L(" rank. Experience may be acting as an unintended proxy variable. Verify that ranking weights reflect job requirements, not seniority."))).otherwise(S(L("Experience–rank correlation is within acceptable bounds (|r|="), fixed(size, 3), L(").")))
    note = S(L("Pearson r(experience, rank) = "), fixed(F.col("r"), 3), L(" (|r|="), fixed(size, 3), L(f", threshold={CORRELATION}). "), rest)
    note = F.when(F.col("n") < LEAST_FOR_CORRELATION, f"Fewer than {LEAST_FOR_CORRELATION} candidates with parsed data — correlation check skipped.").otherwise(note)
    detail = F.struct(rounded(F.col("r"), 4).alias("pearson_r"), rounded(size, 4).alias("abs_r"), L(CORRELATION).alias("threshold"), F.col("n").alias("candidates_analysed"), way.alias("correlation_direction"))
    return _result(a, "experience_correlation", "Experience Proxy Bias", strong, note, detail)


def quality_spread(ranking: DataFrame) -> DataFrame:
    """Flagged when quality scores differ by more than QUALITY_SPREAD."""
    a = ranking.agg(F.count("*").alias("n"), F.min("quality_score").alias("lo"), F.max("quality_score").alias("hi")).withColumn("spread", F.col("hi") - F.col("lo"))
    wide = F.col("spread") > QUALITY_SPREAD
    rest = F.when(wide, "Large variation in CV formatting quality is significantly affecting final scores (quality contributes up to 15% bonus). Candidates with poorly-formatted CVs may be unfairly penalised.").otherwise("CV quality score spread is within acceptable bounds.")
    note = S(L("Quality score spread = "), fixed(F.col("spread"), 3), F.when(wide, " (> ").otherwise(" (<= "), L(f"{QUALITY_SPREAD}). "), rest)
    note = F.when(F.col("n") < 2, "Fewer than 2 candidates — quality spread check skipped.").otherwise(note)
    r = lambda c: rounded(F.col(c) if isinstance(c, str) else c, 4)
    return _result(a, "quality_score_spread", "CV Quality Score Influence", (F.col("n") >= 2) & wide, note, F.struct(r("lo").alias("min"), r("hi").alias("max"), r("spread").alias("spread"), L(QUALITY_SPREAD).alias("threshold")))


def parsed_coverage(ranking: DataFrame, parsed: DataFrame) -> DataFrame:
    """Flagged when ranked candidates have no parsed record; the first NAMED by id are named."""
    a = named(ranking.join(parsed.select("candidate_id"), "candidate_id", "left_anti"), "candidate_id").crossJoin(ranking.agg(F.count("*").alias("total")))
    n = F.col("n")
    said = S(n.cast("string"), L(" ranked candidate(s) have no parsed JSON: "), F.col("said"), L(". These candidates were scored with default quality (0.5) and zero keyword matches, which may disadvantage them unfairly."))
    return _result(a, "parsed_coverage", "Parsed Data Coverage", n > 0, F.when(n > 0, said).otherwise("All ranked candidates have corresponding parsed JSON files."), F.struct(F.col("total").alias("total_ranked"), F.col("ids").alias("missing_parsed"), n.alias("missing_count")))


def all_checks(ranking: DataFrame, parsed: DataFrame, months: DataFrame) -> DataFrame:
    """All seven checks, in order (column ord)."""
    parts = [score_distribution(ranking), score_compression(ranking), skill_gap(ranking), semantic_gap(ranking), experience_correlation(ranking, months), quality_spread(ranking), parsed_coverage(ranking, parsed)]
    return reduce(DataFrame.unionByName, (p.withColumn("ord", L(k)) for k, p in enumerate(parts, 1)))


def summary(checks: DataFrame) -> DataFrame:
    """One row: checks, flags raised, whether any, and its label."""
    a = checks.agg(F.count("*").alias("total_checks"), F.count_if("flagged").alias("flags_raised"))
    return a.withColumn("overall_flag", F.col("flags_raised") > 0).withColumn("overall_label", F.when(F.col("flags_raised") > 0, "BIAS RISK DETECTED").otherwise("NO BIAS SIGNALS DETECTED"))
