"""Read queries over results: lists, neighbours, exports, dashboard numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import fixed


def verdict_key(verdict: Column) -> Column:
    return F.replace(F.lower(verdict), F.lit(" "), F.lit("_"))


def filter_verdict(explanations: DataFrame, key: str = "all") -> DataFrame:
    """Rows of one verdict (strong_match ...) in order of rank, rows without one last; all of them for `all` or an empty key."""
    out = explanations if key in ("", "all") else explanations.where(verdict_key(F.col("verdict")) == key)
    return out.orderBy(F.col("rank").asc_nulls_last())


def verdicts(explanations: DataFrame) -> DataFrame:
    return explanations.where("verdict != ''").select("verdict").distinct().orderBy("verdict")


def neighbours(ranking: DataFrame) -> DataFrame:
    """candidate_id, rank, prev_id, next_id. Ranks are 1..n, so neighbours are found by equi-join, not by one window."""
    r = ranking.select("candidate_id", "rank")
    prev = r.select(F.col("candidate_id").alias("prev_id"), (F.col("rank") + 1).alias("rank"))
    next_ = r.select(F.col("candidate_id").alias("next_id"), (F.col("rank") - 1).alias("rank"))
    return r.join(prev, "rank", "left").join(next_, "rank", "left").select("candidate_id", "rank", "prev_id", "next_id")


def csv_rows(explanations: DataFrame) -> DataFrame:
    """The ten columns of the ranking export, as text; a score that is not a number is told as nan."""
    f = lambda c: F.when(F.isnan(c), "nan").otherwise(fixed(F.coalesce(F.col(c), F.lit(0.0)), 4))
    b, s = "explanation.score_breakdown", "explanation.skills"
    return explanations.select(
        F.col("rank").cast("string").alias("Rank"), F.col("candidate_id").alias("Candidate ID"), f("final_score").alias("Final Score"), F.col("verdict").alias("Verdict"),
        f(f"{b}.semantic_score.value").alias("Semantic Score"), f(f"{b}.keyword_score.value").alias("Keyword Score"), f(f"{b}.quality_score.value").alias("Quality Score"),
        F.array_join(f"{s}.matched", "; ").alias("Matched Skills"), F.array_join(f"{s}.missing", "; ").alias("Missing Skills"), F.col("explanation.recommendation").alias("Recommendation"),
    )


#: Verdict -> its badge, and least final score -> its band. Fixed values.
BADGES = {"Strong Match": "strong", "Good Match": "good", "Partial Match": "partial"}
BANDS = ((0.75, "excellent"), (0.55, "good"), (0.40, "fair"))


def candidate_cards(explanations: DataFrame, ranking: DataFrame) -> DataFrame:
    """What a candidate's page says at its top, one row each: badge (weak for any other verdict), score as a percentage, band, neighbours.

    Rows without a score have 0%, the band poor, and no neighbours without a rank.
    """
    verdict, score = F.col("verdict"), F.coalesce("final_score", F.lit(0.0))
    badge = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in BADGES.items() for x in p)), verdict), F.lit("weak"))
    band = reduce(lambda rest, b: F.when(score >= b[0], b[1]).otherwise(rest), reversed(BANDS), F.lit("poor"))
    own = explanations.select("candidate_id", "rank", "verdict", "headline", badge.alias("badge"), F.concat(F.call_function("format_number", score * 100, F.lit("0")), F.lit("%")).alias("score"), band.alias("band"))
    return own.join(neighbours(ranking).drop("rank"), "candidate_id", "left")


def latest_run(runs: DataFrame, n: int = 1) -> DataFrame:
    """The last n runs by start; of equal starts the larger run_id first."""
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def dashboard_stats(runs: DataFrame, ranking: DataFrame, checks: DataFrame, run_id: str | None = None) -> DataFrame:
    """One row for a run (the latest if None): candidates, status, top candidate and score, flags raised."""
    run = runs.where(F.col("run_id") == run_id) if run_id else latest_run(runs)
    top = ranking.groupBy("run_id").agg(F.min_by("candidate_id", "rank").alias("top_candidate"), F.min_by("final_score", "rank").alias("top_score"))
    flags = checks.groupBy("run_id").agg(F.sum("flagged").alias("flags_raised"))
    out = run.select("run_id", "total_cvs", F.col("status").alias("run_status"), "started_at", "finished_at").join(top, "run_id", "left").join(flags, "run_id", "left")
    return out.withColumns({"top_score": F.coalesce("top_score", F.lit(0.0)), "flags_raised": F.coalesce("flags_raised", F.lit(0))})


def stage_totals(df: DataFrame, key: str) -> DataFrame:
    """Rows by key with shares; a report."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
