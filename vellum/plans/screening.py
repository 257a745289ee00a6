"""The whole screening run as one plan: texts and a job description in, all result tables out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.errors import EmptyQueryError
from vellum.functions.parse import parse_texts
from vellum.functions.redact import Tagger, anonymize
from vellum.functions.taxonomy import Taxonomy, job_skills
from vellum.operators import audit, fairness
from vellum.operators.dedup import near_duplicates
from vellum.operators.explanations import explain_ranking
from vellum.operators.rank import global_rank, rank_candidates, score_candidates
from vellum.session import checkpointed


@dataclass
class Screening:
    """Result tables of a run; those from ranking to gdpr are None without a job description, duplicates where none are looked for."""

    vault: DataFrame
    parsed: DataFrame
    ranking: DataFrame | None = None
    explanations: DataFrame | None = None
    checks: DataFrame | None = None
    events: DataFrame | None = None
    gdpr: DataFrame | None = None
    duplicates: DataFrame | None = None


def near_duplicates_of(texts: DataFrame, vault: DataFrame) -> DataFrame:
    """(candidate_id, duplicate_of): candidates whose text is close to an earlier kept one's redacted text, in order of their numbers.

    Ids are in order of length first, so Candidate_100 comes after Candidate_99.
    """
    order = global_rank(texts.select("candidate_id").where("candidate_id is not null").distinct(), F.length("candidate_id"), F.col("candidate_id"), name="key")
    order = checkpointed(order.select(F.col("candidate_id").alias("id"), "key"))
    numbered = lambda df: df.join(order, F.col("candidate_id") == F.col("id")).select("key", "text")
    found = near_duplicates(numbered(texts), numbered(vault)).where("not kept")
    first = order.select(F.col("key").alias("duplicate_of"), F.col("id").alias("first"))
    return found.join(order, "key").join(first, "duplicate_of").select(F.col("id").alias("candidate_id"), F.col("first").alias("duplicate_of"))


def screen(
    texts: DataFrame,
    job: str | None,
    taxonomy: Taxonomy,
    at: datetime,
    semantic: DataFrame | None = None,
    level: str = "STRICT",
    role: str = "mid",
    raw_files: int = 0,
    tagger: Callable[[], Tagger] | None = None,
    drop_duplicates: bool = False,
    skip: tuple[str, ...] = (),
) -> Screening:
    """Run all stages over texts (candidate_id, text, original_filename).

    at: the clock of the run; nothing reads another. semantic: (candidate_id, semantic_score), 0.5 for all if None.
    skip: stages (ranking, explainability, bias, audit) whose work is left out; later ones see no rows of theirs.
    drop_duplicates: whether near-duplicates of earlier candidates go before anything but redaction sees them; the table
    duplicates then tells which. Redacted and parsed texts are used by several stages and are checkpointed once.
    """
    vault = checkpointed(anonymize(texts.select("candidate_id", "text", "original_filename"), level, tagger))
    duplicates = None
    if drop_duplicates:
        duplicates = checkpointed(near_duplicates_of(texts, vault))
        vault = checkpointed(vault.join(duplicates.select("candidate_id"), "candidate_id", "left_anti"))
    parsed = checkpointed(parse_texts(vault, taxonomy, date(at.year, at.month, at.day)))
    out = Screening(vault, parsed, duplicates=duplicates)
    spark, run, started = texts.sparkSession, at.strftime("RUN_%Y%m%d_%H%M%S"), at.strftime("%Y-%m-%dT%H:%M:%S")
    due = spark.range(1).select(audit.retention_due(F.lit(at.date()))).first()[0]
    if job is None or "ranking" in skip:
        ranking = spark.createDataFrame([], "candidate_id string, rank int, final_score double, semantic_score double, keyword_score double, quality_score double, matched_skills array<string>, missing_skills array<string>, jd_skill_count int")
        explanations = explain_ranking(ranking, parsed, 0, role, started)
    else:
        if not job.strip():
            raise EmptyQueryError("the job description is empty", stage="ranking")
        names = [n for group in taxonomy.names.values() for n in group]
        wanted = spark.range(1).select(job_skills(F.lit(job), names)).first()[0]
        flat = parsed.select("candidate_id", F.flatten(F.map_values("sections.skills")).alias("skills"), "quality_score")
        ranking = checkpointed(rank_candidates(score_candidates(vault, flat, wanted, semantic)))
        told = "explainability" not in skip
        explanations = checkpointed(explain_ranking(ranking, parsed, None, role, started)) if told else explain_ranking(ranking.limit(0), parsed, 0, role, started)
        months = parsed.select("candidate_id", F.col("sections.total_experience_months").alias("total_experience_months"))
        out.ranking, out.explanations = ranking, explanations if told else None
        out.checks = None if "bias" in skip else fairness.all_checks(ranking, parsed, months)
    if "audit" in skip:
        return out
    out.gdpr = audit.gdpr_checks(vault, explanations, ranking, raw_files, run)
    ok = out.gdpr.agg(F.bool_and("satisfied")).first()[0]
    out.events = audit.event_log(vault, parsed, ranking, explanations, run, started, due, ok)
    return out
