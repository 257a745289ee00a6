"""Where intermediate tables go, and rows known by id and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import Tables as Scratch
from vellum.session import checkpointed, shared_dir, ship

__all__ = ["Scratch", "checkpointed", "matched", "shared_dir", "ship"]


def matched(documents: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """documents joined (left_semi or left_anti) with rows (doc_id, text_hash) by doc_id, null safe, and a hash of the text."""
    names = iter(f"vellum_{k}" for k in range(len(documents.columns) + 2) if f"vellum_{k}" not in documents.columns)
    one, two = next(names), next(names)
    rows = rows.select(F.col("doc_id").alias(one), F.col("text_hash").alias(two)).distinct()
    return documents.join(rows, F.col("doc_id").eqNullSafe(F.col(one)) & (F.xxhash64("text") == F.col(two)), how)
