"""Audit events, compliance checks and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.patterns import HUMAN_REVIEW_WORDS
from vellum.functions.text import fixed
from vellum.operators.fairness import named
from vellum.operators.rank import global_rank

S, L = F.concat, F.lit
RETENTION_DAYS = 30
#: Fields of the envelope; all others are extras.
ENVELOPE = ("event_id", "event_type", "stage", "candidate_id", "severity", "description", "timestamp", "legal_basis")
LEGAL_BASIS = (
    "Legitimate interest (GDPR Art. 6(1)(f)) — automated CV screening with human review to prevent unconscious bias in recruitment decisions."
)


def retention_due(run_date: Column) -> Column:
    return F.date_format(F.date_add(run_date, RETENTION_DAYS), "yyyy-MM-dd")


def run_id(at: Column) -> Column:
    return F.date_format(at, "'RUN_'yyyyMMdd_HHmmss")


def _n(c: Column) -> Column:
    return c.cast("string")


def _two(c: Column, places: int = 1) -> Column:
    return fixed(c, places)


def _events(df: DataFrame, group: int, kind: str, stage: str, said: Column, extra: Column, severity: Column | str = "INFO", at: Column | None = None, order: Column | None = None) -> DataFrame:
    """Envelope rows: group_ord and sort_key place them in the log."""
    severity = L(severity) if isinstance(severity, str) else severity
    cid = F.col("candidate_id") if "candidate_id" in df.columns else L(None).cast("string")
    key = (order if order is not None else F.coalesce(cid, L(""))).cast("string")
    return df.select(L(group).alias("group_ord"), key.alias("sort_key"), L(kind).alias("event_type"), L(stage).alias("stage"), cid.alias("candidate_id"), said.alias("description"), severity.alias("severity"), (at if at is not None else L(None).cast("string")).alias("timestamp"), F.to_json(extra).alias("extra"))


def _rank_key(rank: Column) -> Column:
    return F.format_string("%012d", F.coalesce(rank, L(9999)).cast("long"))


def received(vault: DataFrame) -> DataFrame:
    name = F.coalesce("original_filename", L("unknown"))
    said = S(L("Raw CV received: '"), name, L("'. Assigned anonymous ID: "), F.col("candidate_id"), L("."))
    return _events(vault, 2, "CV_RECEIVED", "module0", said, F.struct(name.alias("original_filename"), L(False).alias("data_retained")))


def pii_removed(vault: DataFrame) -> DataFrame:
    """What was removed from each text; WARNING where validation found leaks."""
    passed, sure = F.coalesce("validation_score.passed", L(False)), F.coalesce("validation_score.confidence_score", L(0.0))
    counted = F.filter(F.map_entries("pii_categories_found"), lambda e: ~e["key"].isin("ner_persons", "heuristic_names") & (e["value"] > 0))
    parts = F.concat(F.array_compact(F.array(F.when(F.col("original_name").isNotNull(), "name"))), F.transform(counted, lambda e: S(_n(e["value"]), L(" "), F.replace(e["key"], L("_"), L(" ")))))
    what = F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("no PII detected")
    said = S(L("PII removed: "), what, L(". Anonymization level: "), F.col("anonymization_level_used"), L(". Validation "), F.when(passed, "passed").otherwise("flagged issues"), L(" (confidence: "), _two(sure), L("%)."))
    technique = F.when(F.size("techniques_applied") > 0, F.array_join("techniques_applied", " + ")).otherwise("unknown")
    extra = F.struct(F.map_keys("pii_categories_found").alias("pii_categories"), F.col("pii_categories_found").alias("pii_counts"), technique.alias("technique"), F.col("anonymization_level_used").alias("anonymization_level"), passed.alias("validation_passed"), F.round(sure, 2).alias("validation_confidence"), L(False).alias("data_retained"))
    return _events(vault, 3, "PII_REMOVED", "module0", said, extra, F.when(passed, "INFO").otherwise("WARNING"))


def parsed_events(parsed: DataFrame) -> DataFrame:
    s = F.col("sections")
    skills, roles, schools, warned = F.size(F.flatten(F.map_values(s["skills"]))), F.size(s["experience"]), F.size(s["education"]), F.size("parse_warnings")
    said = S(L("CV parsed: "), _n(skills), L(" skills extracted, "), _n(roles), L(" role(s), "), _n(schools), L(" education entry(ies). Quality score: "), _two(F.col("quality_score"), 2), L(". "), _n(warned), L(" parse warning(s)."))
    extra = F.struct(F.round("quality_score", 4).alias("quality_score"), skills.alias("skills_extracted"), s["total_experience_months"].alias("experience_months"), roles.alias("roles_detected"), schools.alias("education_entries"), warned.alias("parse_warnings_count"), L(True).alias("data_retained"))
    return _events(parsed, 4, "CV_PARSED", "module0b", said, extra, F.when(warned > 0, "WARNING").otherwise("INFO"), F.date_format("parsed_at", "yyyy-MM-dd'T'HH:mm:ss"))


def ranked_events(ranking: DataFrame) -> DataFrame:
    f = lambda c: _two(F.col(c), 4)
    said = S(L("Ranked #"), _n(F.col("rank")), L(": final_score="), f("final_score"), L(" (semantic="), f("semantic_score"), L(", keyword="), f("keyword_score"), L(", quality="), f("quality_score"), L("). "), _n(F.size("matched_skills")), L(" of "), _n(F.col("jd_skill_count")), L(" JD skills matched."))
    scores = [F.round(c, 4).alias(c) for c in ("final_score", "semantic_score", "keyword_score", "quality_score")]
    extra = F.struct("rank", *scores, "matched_skills", "missing_skills", "jd_skill_count", L(True).alias("data_retained"), L("SBERT cosine similarity + keyword overlap").alias("scoring_method"))
    return _events(ranking, 5, "CANDIDATE_RANKED", "module1", said, extra, order=_rank_key(F.col("rank")))


def explained_events(explanations: DataFrame) -> DataFrame:
    line = F.coalesce("headline", L("No headline"))
    short = S(F.substring(line, 1, 80), F.when(F.length(line) > 80, "…").otherwise(""))
    said = S(L("Explanation generated for rank #"), _n(F.col("rank")), L(". Verdict: "), F.col("verdict"), L('. Headline: "'), short, L('".'))
    extra = F.struct("rank", "verdict", F.substring(F.col("explanation.recommendation"), 1, 200).alias("recommendation"), L(True).alias("data_retained"), L(True).alias("human_review_flag"))
    return _events(explanations, 6, "EXPLANATION_WRITTEN", "module2", said, extra, at=F.col("generated_at"), order=_rank_key(F.col("rank")))


def retained_events(vault: DataFrame, due: str) -> DataFrame:
    said = L(f"Anonymized CV and parsed data retained in vault. Original PII stored in encrypted vault only. Retention deadline: {due}.")
    extra = F.struct(L("vault/").alias("retained_in"), L(RETENTION_DAYS).alias("retention_days"), L(due).alias("deletion_due"), L(True).alias("data_retained"))
    return _events(vault, 7, "DATA_RETAINED", "module3", said, extra)


def warning_events(vault: DataFrame, parsed: DataFrame, ranking: DataFrame, explanations: DataFrame) -> DataFrame:
    """Failed validation, three parse warnings or more, ranked but not explained, redacted but not ranked."""
    cid, no = F.col("candidate_id"), F.struct(L(False).alias("data_retained"))
    v = F.col("validation_score")
    leaks = F.size(v["leaks_found"])
    failed = vault.where(~F.coalesce(v["passed"], L(True)))
    one = _events(failed, 8, "WARNING", "module0", S(L("PII validation did not pass for "), cid, L(". Confidence: "), _two(v["confidence_score"]), L("%. "), _n(leaks), L(" potential leak(s) detected. Manual review of anonymized CV recommended.")), F.struct(v["confidence_score"].alias("validation_confidence"), leaks.alias("leaks_detected"), L(False).alias("data_retained")), "WARNING", order=S(L("1"), cid))
    n = F.size("parse_warnings")
    two = _events(parsed.where(n >= 3), 8, "WARNING", "module0b", S(_n(n), L(" parse warning(s) recorded for "), cid, L(". CV structure may be non-standard. Extraction accuracy may be reduced.")), F.struct(F.slice("parse_warnings", 1, 5).alias("parse_warnings"), L(False).alias("data_retained")), "WARNING", order=S(L("2"), cid))
    three = _events(ranking.join(explanations.select("candidate_id"), "candidate_id", "left_anti"), 8, "WARNING", "module2", S(cid, L(" was ranked by module1 but has no explanation in the explanations/ directory. Transparency requirement (Art. 13) may be affected.")), no, "WARNING", order=S(L("3"), cid))
    four = _events(vault.join(ranking.select("candidate_id"), "candidate_id", "left_anti"), 8, "WARNING", "module1", S(cid, L(" was anonymized by module0 but does not appear in ranking_details. The candidate may not have been ranked — check the job description and anonymized_cvs/ directory.")), no, "WARNING", order=S(L("4"), cid))
    return reduce(DataFrame.unionByName, (one, two, three, four))


def event_log(vault: DataFrame, parsed: DataFrame, ranking: DataFrame, explanations: DataFrame, run: str, started: str, due: str, compliant: bool, version: str = "1.0") -> DataFrame:
    """EVENT rows in order, numbered EVT_001 on: start, eight groups, completion."""
    spark = vault.sparkSession
    n = max(vault.count(), ranking.count(), parsed.count())
    one = spark.range(1).select(L(None).cast("string").alias("candidate_id"))
    first = _events(one, 1, "PIPELINE_START", "main", L(f"Pipeline run {run} started. {n} candidate CV(s) submitted for processing."), F.struct(L(version).alias("pipeline_version"), L(run).alias("run_id"), L(n).alias("n_candidates"), L(False).alias("data_retained")))
    body = reduce(DataFrame.unionByName, (first, received(vault), pii_removed(vault), parsed_events(parsed), ranked_events(ranking), explained_events(explanations), retained_events(vault, due), warning_events(vault, parsed, ranking, explanations)))
    total = body.count() + 1
    state = "COMPLIANT" if compliant else "PARTIAL — see checklist"
    last = _events(one, 9, "PIPELINE_COMPLETE", "module3", L(f"Pipeline run {run} complete. {n} candidate(s) processed. {total} audit events recorded. GDPR compliance status: {state}."), F.struct(L(run).alias("run_id"), L(n).alias("n_candidates"), L(total).alias("total_events"), L(compliant).alias("gdpr_compliant"), L(False).alias("data_retained")))
    ranked = global_rank(body.unionByName(last), F.col("group_ord"), F.col("sort_key"), F.col("event_type"), name="n")
    return ranked.select("n", F.format_string("EVT_%03d", F.col("n")).alias("event_id"), F.coalesce("timestamp", L(started)).alias("timestamp"), "stage", "event_type", "candidate_id", "description", L(LEGAL_BASIS).alias("legal_basis"), "severity", "extra")


def event_summary(events: DataFrame) -> DataFrame:
    """One row of counts by type and severity."""
    t, s = F.col("event_type"), F.col("severity")
    kinds = {"pii_removal_events": "PII_REMOVED", "cv_parsed_events": "CV_PARSED", "ranking_events": "CANDIDATE_RANKED", "explanation_events": "EXPLANATION_WRITTEN", "data_retained_events": "DATA_RETAINED"}
    return events.agg(F.count("*").alias("total_events"), *(F.count_if(t == v).alias(k) for k, v in kinds.items()), F.count_if(s == "WARNING").alias("warnings"), F.count_if(s == "ERROR").alias("errors"))


def gdpr_checks(vault: DataFrame, explanations: DataFrame, ranking: DataFrame, raw_files: int, run: str, out: str = "audit") -> DataFrame:
    """ord, article, title, satisfied, evidence: six rows."""
    spark = vault.sparkSession
    a = vault.agg(F.count("*").alias("n_vault"), F.coalesce(F.bool_or(F.size("pii_categories_found") > 0), L(False)).alias("has_pii"))
    said = F.lower("explanation.recommendation")
    reviewed = reduce(lambda x, y: x | y, (F.contains(said, L(w)) for w in HUMAN_REVIEW_WORDS))
    failing = named(explanations.where(~F.coalesce(reviewed, L(False))), "candidate_id").first()
    facts = {**a.first().asDict(), "n_told": explanations.count(), "n_ranked": ranking.count()}
    n_vault, told, bad, n_ranked = facts["n_vault"], facts["n_told"], failing["n"], facts["n_ranked"]
    rows = [
        ("article_5", "Principles of processing", n_vault > 0 and facts["has_pii"], f"Vault records found for {n_vault} candidate(s). PII categories identified and removed before ranking.", "Vault is empty or pii_categories_found is missing — cannot confirm PII was properly identified and removed."),
        ("article_13", "Right to information / transparency", told > 0, f"Explanation generated for {told} candidate(s). Each explanation includes score breakdown, verdict, and recommendation.", "No explanation files found in explanations/. Transparency requirement cannot be demonstrated."),
        ("article_17", "Right to erasure", raw_files == 0, "raw_cvs/ directory is empty — original CVs have been removed. Right to erasure can be exercised.", f"{raw_files} raw CV file(s) still present in raw_cvs/. Original CVs must be deleted manually to satisfy Art. 17. Action required: delete all files from raw_cvs/ after processing."),
        ("article_22", "Automated decision-making safeguards", told > 0 and not bad, f"All {told} explanation(s) contain human-review language in their recommendations.", "No explanation files found — cannot verify human review language." if not told else f"{bad} explanation(s) lack explicit human-review language: {failing['said']}. Review module2 recommendation templates."),
        ("article_25", "Data protection by design", n_vault > 0 and n_ranked > 0, f"Anonymization applied to {n_vault} CV(s) by module0 (vault records present). Ranking performed on anonymized text for {n_ranked} candidate(s). Privacy-by-design order confirmed.", "Vault records not found — cannot confirm anonymization preceded ranking." if not n_vault else "No ranking details available — pipeline may not have completed ranking stage."),
        ("article_30", "Records of processing activities", True, f"Full audit log generated at {out}/audit_log.json (run ID: {run}). Records of all processing activities are maintained.", ""),
    ]
    return spark.createDataFrame([(k, a, t, bool(ok), yes if ok else no) for k, (a, t, ok, yes, no) in enumerate(rows, 1)], "ord int, article string, title string, satisfied boolean, evidence string")


#: What to do about an article that isn't satisfied, in order.
REMEDIES = (
    ("article_17", "Delete all files from raw_cvs/ after confirming anonymized_cvs/ are complete and correct."),
    ("article_5", "Re-run module0 to ensure PII removal is applied and vault records are generated."),
    ("article_13", "Re-run module2 to generate explanation files for all candidates."),
    ("article_22", "Review module2 recommendation templates to include explicit human-review language."),
)


def compliance(checks: DataFrame) -> DataFrame:
    """One row: overall_compliant, non_compliant_articles, remediation_required."""
    bad = F.transform(F.array_sort(F.collect_list(F.when(~F.col("satisfied"), F.struct("ord", "article")))), lambda x: x["article"])
    row = checks.agg(F.coalesce(F.bool_and("satisfied"), L(True)).alias("overall_compliant"), bad.alias("non_compliant_articles"))
    todo = F.array(*(F.struct(L(a).alias("a"), L(t).alias("t")) for a, t in REMEDIES))
    return row.withColumn("remediation_required", F.transform(F.filter(todo, lambda x: F.array_contains("non_compliant_articles", x["a"])), lambda x: x["t"]))


def overview(vault: DataFrame, ranking: DataFrame, explanations: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row for each id of any source: PII removed, rank, score, verdict, quality."""
    total = F.aggregate(F.map_values("pii_categories_found"), L(0), lambda a, b: a + b)
    v = vault.select("candidate_id", total.alias("pii_count"))
    r = ranking.select("candidate_id", "rank", "final_score")
    e = explanations.select("candidate_id", "verdict")
    p = parsed.select("candidate_id", "quality_score")
    return v.join(r, "candidate_id", "full").join(e, "candidate_id", "full").join(p, "candidate_id", "left")
