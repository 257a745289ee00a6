"""Streams: new text files through redaction into a table, and (an extension) event counts by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.functions.redact import anonymize
from vellum.functions.text import is_blank, squeeze

#: Hexadecimal digits that name a folder: 256 folders at most.
PREFIX = 2


def redact_stream(spark: SparkSession, folder: str, table: str, checkpoint: str, level: str = "STRICT", also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Each new *.txt file of folder becomes a row of the Parquet table, once for each distinct normalised text.

    The candidate id is a digest of the text, so a file that arrives again adds nothing. The table lies in folders by the
    first PREFIX digits of the digest and by batch: a batch looks for its ids in the folders of its own digits only, and, run again
    after a failure, replaces what it had written, whole or in part.
    """
    schema = "value string"
    files = spark.readStream.schema(schema).option("wholetext", True).option("pathGlobFilter", "*.txt").format("text").load(folder)
    texts = files.where(~is_blank(F.col("value"))).select(F.concat(F.lit("Candidate_"), F.substring(F.sha2(squeeze(F.col("value")), 256), 1, 16)).alias("candidate_id"), F.col("value").alias("text"), F.lit(None).cast("string").alias("original_filename"))

    def write(batch: DataFrame, number: int) -> None:
        own = batch.dropDuplicates(["candidate_id"]).withColumn("prefix", F.substring("candidate_id", len("Candidate_") + 1, PREFIX))
        place = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(table)
        if place.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(place):
            near = [r["prefix"] for r in own.select("prefix").distinct().collect()]
            known = batch.sparkSession.read.schema("candidate_id string, prefix string, batch long").parquet(table)
            known = known.where(F.col("prefix").isin(near) & (F.col("batch") != number)).select("candidate_id")
            own = own.join(known, "candidate_id", "left_anti")
        done = anonymize(own, level).withColumns({"prefix": F.substring("candidate_id", len("Candidate_") + 1, PREFIX), "batch": F.lit(number).cast("long")})
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "batch").parquet(table)
        if also:
            also(done, number)

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by tumbling window and type, for a stream or a table (ts, event_type). An extension."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
