"""Scores of a candidate against a job description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMANTIC_WEIGHT, KEYWORD_WEIGHT, QUALITY_BASE, QUALITY_BONUS = 0.65, 0.35, 0.85, 0.15
#: Score without an embedding model, and quality without a parsed record.
DEFAULT_SEMANTIC, DEFAULT_QUALITY = 0.5, 0.5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where either has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def matched_skills(job: Column, skills: Column) -> Column:
    """Skills of the job that the candidate's (lower-cased) skills hold, in the job's order."""
    return F.filter(job, lambda s: F.array_contains(skills, F.lower(s)))


def missing_skills(job: Column, skills: Column) -> Column:
    return F.filter(job, lambda s: ~F.array_contains(skills, F.lower(s)))


def keyword_score(matched: Column, job: Column) -> Column:
    """Share of the job's skills; 0 for a job without any."""
    return F.when(F.size(job) > 0, F.least(F.lit(1.0), F.size(matched) / F.size(job))).otherwise(F.lit(0.0))


def final_score(semantic: Column, keyword: Column, quality: Column) -> Column:
    mixed = SEMANTIC_WEIGHT * semantic + KEYWORD_WEIGHT * keyword
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed * (QUALITY_BASE + QUALITY_BONUS * quality)))
