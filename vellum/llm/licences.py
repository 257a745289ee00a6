"""Licence scan by canonical digest: entire texts, normalised, hash-joined to the digests of known licences.

All steps are DataFrame expressions; the same expressions normalise the known texts and the scanned ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.licence_texts import LICENCES, SPELLINGS

#: A line that names a holder: the word or sign, then a year, a sign or a placeholder. Found after lower-casing.
COPYRIGHT_LINE = r"\n[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|<year>|\[year\]|\[yyyy\])|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: The most known digests that are broadcast; a longer list is joined by shuffle.
BROADCAST_ROWS = 1 << 16


#: What some copyright line holds; texts without have no line to drop.
HOLDERS = ("copyright", "(c)", "©", "all rights reserved")
#: Texts without any variant are left as they are, which is what replacing them all would do.
VARIANT = " (?:" + "|".join(variant for variant, _ in SPELLINGS) + ") "


def normalised(text: Column) -> Column:
    """Lower case, no copyright lines, words only with one space between, equivalent spellings replaced; null: empty.

    Spellings are replaced one after the other, so a variant that an earlier one makes is replaced as well.
    """
    s = F.concat(F.lit("\n"), F.lower(F.coalesce(text, F.lit(""))))
    s = F.when(_any(s, HOLDERS), F.regexp_replace(s, COPYRIGHT_LINE, "\n")).otherwise(s)
    s = F.concat(F.lit(" "), F.regexp_replace(s, NOT_WORD, " "), F.lit(" "))
    spelt = F.replace(s, F.lit(" "), F.lit("  "))
    for variant, standard in SPELLINGS:
        spelt = F.replace(spelt, F.lit(f" {variant.replace(' ', '  ')} "), F.lit(f" {standard.replace(' ', '  ')} "))
    s = F.when(s.rlike(VARIANT), F.replace(spelt, F.lit("  "), F.lit(" "))).otherwise(s)
    return F.trim(F.replace(s, F.lit("  "), F.lit(" ")))


def _any(s: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(s, F.lit(p)) for p in parts))


def known_licences(spark: SparkSession, texts: dict[str, str] = LICENCES) -> DataFrame:
    """licence_id, text of the built-in list."""
    return spark.createDataFrame(list(texts.items()), "licence_id string, text string")


def scan_licences(documents: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, n_canonical_chars, canonical_sha256, licence_id of every row of documents (doc_id, text).

    licence_id is null unless the whole text is a known licence. Of known licences with one digest the smallest id
    stands. Texts that are empty after normalisation (null, empty, punctuation) match nothing. Repeated rows stay;
    other columns of either table are not read.
    """
    digest = F.sha2(F.col("canonical"), 256)
    list_ = known.select("licence_id", normalised(F.col("text")).alias("canonical")).where("canonical != ''")
    list_ = list_.select("licence_id", digest.alias("known_sha256")).groupBy("known_sha256").agg(F.min("licence_id").alias("licence_id"))
    if list_.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        list_ = F.broadcast(list_)
    scanned = documents.select("doc_id", normalised(F.col("text")).alias("canonical"))
    scanned = scanned.select("doc_id", F.length("canonical").cast("long").alias("n_canonical_chars"), digest.alias("canonical_sha256"))
    return scanned.join(list_, F.col("canonical_sha256") == F.col("known_sha256"), "left").select("doc_id", "n_canonical_chars", "canonical_sha256", "licence_id")
