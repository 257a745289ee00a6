"""A corpus for training: rules, near-duplicates, leaks, personal data, pieces. Each stage reads what the last one wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontam, minhash, pieces, pii, quality
from vellum.llm._stage import Scratch, ship

#: No oracle: hashes, bootstrapped patterns and pieces have no SQL form. Tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The verdict depends on the text alone, so rows with one doc_id and one text agree."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept_documents(docs, labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id, once. Unlike texts with one doc_id are judged apart."""
    return minhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked; n_chars follows the text."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document."""
    return pieces.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes Parquet in the shared folder, which the next one reads. A stage's table is
    removed when the next one is written; the last one's is the result."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = tables.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            tables.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
