"""Sinks: tables, JSON records, error lines, exports, digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.audit import event_summary
from vellum.operators.digest import event_text, tree_root
from vellum.operators.views import csv_rows
from vellum.plans.report import audit_report
from vellum.schemas import EVENT


def write_table(df: DataFrame, path: str, *partitions: str, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_texts(df: DataFrame, path: str) -> None:
    """One folder for each candidate with its text."""
    df.select("candidate_id", "text").write.mode("overwrite").partitionBy("candidate_id").text(path, lineSep="\x00")


def write_json(df: DataFrame, path: str) -> None:
    """Records as JSON lines; vaults go to a path of their own with tighter rights."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def error_lines(files: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """line, file_name, kind (SKIPPED, DUPLICATE, FAILED), detail of what was not processed."""
    bad = files.where("status != 'OK'").select("file_name", F.col("status").alias("kind"), F.coalesce("error", F.lit("")).alias("detail"))
    if duplicates is not None:
        bad = bad.unionByName(duplicates.select("file_name", F.lit("DUPLICATE").alias("kind"), F.concat(F.lit("near-duplicate of "), "duplicate_of").alias("detail")))
    return bad.select(F.concat_ws(" ", F.concat(F.lit("["), "kind", F.lit("]")), "file_name", "detail").alias("line"), "file_name", "kind", "detail")


def ranking_lines(ranking: DataFrame) -> DataFrame:
    """rank, line of the short ranking report."""
    return ranking.select("rank", F.format_string("%3d. %s  final=%.4f  semantic=%.4f  keyword=%.4f  quality=%.4f", "rank", "candidate_id", "final_score", "semantic_score", "keyword_score", "quality_score").alias("line"))


def write_csv(explanations: DataFrame, path: str) -> None:
    """The ranking export, sorted by rank across part files."""
    csv_rows(explanations.orderBy(F.col("rank").asc_nulls_last())).write.mode("overwrite").csv(path, header=True, emptyValue="")


def record_digest(record: Column) -> Column:
    """SHA-256 of a record as JSON."""
    return F.sha2(F.to_json(record), 256)


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file's bytes, on the driver, from Spark's reader."""
    return hashlib.sha256(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])).hexdigest()


def digest_line(digest: str, name: str = "audit_log.json") -> str:
    return f"{digest}  {name}\n"


def write_audit(events: DataFrame, gdpr: DataFrame, folder: str, run_id: str) -> str:
    """The audit of a run in one folder: events, checklist, report, and the digest of the events in a file beside them.

    The digest is the root of the tree over the events in order of n; verify_audit makes it again from what was written.
    """
    write_json(events, f"{folder}/events")
    write_json(gdpr, f"{folder}/gdpr")
    root = tree_root(events, event_text(events.columns), F.col("n"))
    report = audit_report(events, gdpr, event_summary(events), run_id, root)
    for name, text in (("audit_report", report), ("audit_log.sha256", digest_line(root).rstrip("\n"))):
        events.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    return root


def verify_audit(spark: SparkSession, folder: str) -> bool:
    """Whether the events that lie in a folder have the digest that lies beside them."""
    events = spark.read.schema(f"n int, {EVENT}").json(f"{folder}/events")
    told = spark.read.text(f"{folder}/audit_log.sha256").first()["value"]
    return told == digest_line(tree_root(events, event_text(events.columns), F.col("n"))).rstrip("\n")


#: Folders that records are dealt to for lookups.
LOOKUP_BUCKETS = 1024


def lookup_bucket(candidate_id: Column, buckets: int = LOOKUP_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(candidate_id), F.lit(buckets)).cast("int")


def write_lookup(records: DataFrame, path: str, buckets: int = LOOKUP_BUCKETS) -> None:
    """Records by candidate_id in folders by a hash of the id, so that a lookup reads one of them."""
    own = records.withColumn("lookup_bucket", lookup_bucket(F.col("candidate_id"), buckets))
    own.repartition("lookup_bucket").sortWithinPartitions("lookup_bucket", "candidate_id").write.mode("overwrite").partitionBy("lookup_bucket").parquet(path)
