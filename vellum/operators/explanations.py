"""Explanations of a ranking: one nested record for each candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import explain as E
from vellum.functions.text import fixed, percent, rounded
from vellum.schemas import EDUCATION


def explain_ranking(ranking: DataFrame, parsed: DataFrame, n_candidates: int | None = None, role: str = "mid", generated_at: str = "") -> DataFrame:
    """candidate_id, rank, final_score, verdict, headline, explanation, generated_at of each ranking row.

    parsed: PARSED rows, joined left; without one the explanation says that data are missing. n_candidates: as counted if
    None.
    """
    n = ranking.count() if n_candidates is None else n_candidates
    # Only what is told of a record meets the ranking: the record itself holds whole texts.
    education = F.coalesce("sections.education", F.array().cast(f"array<{EDUCATION}>"))
    known = parsed.select("candidate_id", F.col("sections.total_experience_months").alias("months"), F.size("sections.experience").alias("roles"), E.highest_education(education).alias("best"), F.lit(True).alias("known"))
    c = F.col
    unknown = F.struct(F.lit("").alias("level"), F.lit("").alias("field"))
    df = ranking.join(known, "candidate_id", "left").withColumns(
        {
            "known": F.coalesce("known", F.lit(False)),
            "months": F.coalesce("months", F.lit(0)),
            "roles": F.coalesce("roles", F.lit(0)),
            "best": F.coalesce("best", unknown),
            "verdict": E.verdict(c("final_score"), role),
            "matched": F.size("matched_skills"),
        }
    )
    df = df.withColumn("strengths", E.strengths(c("keyword_score"), c("semantic_score"), c("months"), c("quality_score"), c("best.level"), c("best.field"), c("missing_skills")))
    part = lambda name, note: F.struct(rounded(c(name), 4).alias("value"), E.score_label(c(name)).alias("label"), note.alias("note")).alias(name)
    null_if_empty = lambda x: F.when(x != "", x)
    total = c("jd_skill_count")
    years = F.when(c("months") > 0, fixed(F.bround(c("months") / 12, 1), 1)).otherwise("0")
    told = F.struct(
        F.struct(
            part("semantic_score", E.semantic_note(c("semantic_score"))),
            part("keyword_score", E.keyword_note(c("matched"), total)),
            part("quality_score", E.quality_note(c("quality_score"))),
            F.struct(rounded(c("final_score"), 4).alias("value"), c("verdict").alias("label")).alias("final_score"),
        ).alias("score_breakdown"),
        F.struct(
            c("matched_skills").alias("matched"),
            c("missing_skills").alias("missing"),
            F.when(total > 0, percent(c("keyword_score"))).otherwise("N/A").alias("match_rate"),
            E.skills_summary(c("matched"), total, c("missing_skills")).alias("summary"),
        ).alias("skills"),
        F.struct(c("months").alias("total_months"), years.alias("total_years"), E.experience_summary(c("months"), c("roles"), c("known")).alias("summary")).alias("experience"),
        F.struct(null_if_empty(c("best.level")).alias("highest_level"), null_if_empty(c("best.field")).alias("field"), E.education_summary(c("best.level"), c("best.field"), c("known")).alias("summary")).alias("education"),
        "strengths",
        E.gaps(c("missing_skills"), c("months"), c("keyword_score"), c("quality_score"), c("known")).alias("gaps"),
        E.recommendation(c("verdict"), c("strengths"), c("missing_skills")).alias("recommendation"),
    )
    return df.select("candidate_id", "rank", rounded(c("final_score"), 4).alias("final_score"), "verdict", E.headline(c("rank"), F.lit(n), c("verdict"), c("months")).alias("headline"), told.alias("explanation"), F.lit(generated_at).alias("generated_at"))


def verdict_histogram(explanations: DataFrame) -> DataFrame:
    """One row: candidates, the four verdicts, recommended (strong or good) and its share, average final score.

    Scores have four places, so they are summed as decimals: the average doesn't depend on the order of rows. It is rounded
    to six places, half up.
    """
    n = lambda v: F.count_if(F.col("verdict") == f"{v} Match")
    row = explanations.agg(F.count("*").alias("n"), n("Strong").alias("n_strong"), n("Good").alias("n_good"), n("Partial").alias("n_partial"), n("Weak").alias("n_weak"), F.sum(F.col("final_score").cast("decimal(20,4)")).alias("total"))
    average = F.round(F.try_divide("total", F.col("n").cast("decimal(19,0)")), 6).cast("double")
    row = row.withColumns({"n_recommended": F.col("n_strong") + F.col("n_good"), "avg_score": F.coalesce(average, F.lit(0.0))}).drop("total")
    return row.withColumn("recommended_share", F.coalesce(F.try_divide("n_recommended", "n"), F.lit(0.0)))
