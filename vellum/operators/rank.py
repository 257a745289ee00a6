"""Ranking of candidates against one job description."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import scoring as S
from vellum.functions.text import is_blank, sql_round
from vellum.session import checkpointed


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with 1..n in a total order, without moving all rows to one partition.

    Rows are dealt by range and sorted within partitions; a partition's rows are numbered in place and shifted by the
    size of the partitions before it (one number for each partition). The order must have no ties.
    """
    place, part = F.monotonically_increasing_id(), F.spark_partition_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = checkpointed(dealt.withColumns({"_at": F.pmod(place, F.lit(1 << 33)), "_part": part}))
    sizes = sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, shifts = 0, []
    for k, n in sizes:
        shifts.append((k, before))
        before += n
    shift = df.sparkSession.createDataFrame(shifts or [(0, 0)], "_part int, _before long")
    return dealt.join(F.broadcast(shift), "_part").withColumn(name, (F.col("_at") + F.col("_before") + 1).cast("int")).drop("_at", "_part", "_before")


def semantic_scores(vectors: DataFrame, query: DataFrame, key: str = "candidate_id", without: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """key, semantic_score: cosine of each vector (key, embedding) to the one row of query (embedding).

    Where either has no length: without(vector, query), 0.5 if None.
    """
    one = query.select(F.col("embedding").alias("query")).limit(1)
    pair = F.col("embedding"), F.col("query")
    return vectors.crossJoin(F.broadcast(one)).select(key, F.coalesce(S.cosine(*pair), without(*pair) if without else F.lit(S.DEFAULT_SEMANTIC)).alias("semantic_score"))


def score_candidates(texts: DataFrame, parsed: DataFrame, job: list[str], semantic: DataFrame | None = None, keep_blank: bool = False) -> DataFrame:
    """Unranked scores of candidates (candidate_id, text): parsed (candidate_id, skills array, quality_score) joined left.

    A candidate without parsed record has no matched skills and quality 0.5. Blank texts are left out unless keep_blank.
    """
    own = (texts if keep_blank else texts.where(~is_blank(F.col("text")))).select("candidate_id")
    own = own.join(parsed.select("candidate_id", "skills", "quality_score", F.lit(True).alias("is_parsed")), "candidate_id", "left")
    own = own.join(semantic, "candidate_id", "left") if semantic is not None else own.withColumn("semantic_score", F.lit(None).cast("double"))
    jobs = F.array(*map(F.lit, job)) if job else F.array().cast("array<string>")
    skills = F.coalesce(F.transform("skills", F.lower), F.array().cast("array<string>"))
    own = own.select(
        "candidate_id",
        F.coalesce("semantic_score", F.lit(S.DEFAULT_SEMANTIC)).alias("sem"),
        F.coalesce("quality_score", F.lit(S.DEFAULT_QUALITY)).alias("q"),
        S.matched_skills(jobs, skills).alias("matched_skills"),
        S.missing_skills(jobs, skills).alias("missing_skills"),
    )
    own = own.withColumn("kw", S.keyword_score(F.col("matched_skills"), jobs))
    return own.withColumn("raw", S.final_score(F.col("sem"), F.col("kw"), F.col("q"))).withColumn("jd_skill_count", F.lit(len(job)))


def rank_candidates(scores: DataFrame) -> DataFrame:
    """RANKING rows: by unrounded final score, highest first, ties by candidate_id; scores rounded to 6 places after."""
    ranked = global_rank(scores, F.col("raw").desc(), F.col("candidate_id").asc())
    r = lambda c: sql_round(F.col(c), 6)
    return ranked.select("candidate_id", r("raw").alias("final_score"), r("sem").alias("semantic_score"), r("kw").alias("keyword_score"), r("q").alias("quality_score"), "matched_skills", "missing_skills", "jd_skill_count", "rank")
