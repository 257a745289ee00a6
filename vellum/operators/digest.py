"""One digest of a whole log: a hash tree over its rows, built level by level in Spark."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.rank import global_rank

#: Digests under one node.
FANOUT = 256


def tree_levels(rows: DataFrame, leaf: Column, *order: Column) -> list[DataFrame]:
    """(place, digest) of each level, from the leaves up to the one row of the root; none for no rows.

    A leaf is the SHA-256 of 0: and the row's text, a node that of 1: and the digests of up to FANOUT nodes below it in order.
    Rows stand in a total order. A task holds FANOUT digests at a time, whatever the number of rows.
    """
    own = rows.select(F.sha2(F.concat(F.lit("0:"), leaf), 256).alias("digest"), *(c.alias(f"_o{k}") for k, c in enumerate(order)))
    level = global_rank(own, *(F.col(f"_o{k}") for k in range(len(order))), name="n").select((F.col("n") - 1).cast("long").alias("place"), "digest")
    n, levels = level.count(), []
    while n:
        levels.append(level)
        if n == 1:
            break
        above = level.groupBy(F.floor(F.col("place") / FANOUT).alias("up")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("below"))
        level = above.select(F.col("up").alias("place"), F.sha2(F.concat(F.lit("1:"), F.array_join(F.transform("below", lambda x: x["digest"]), "")), 256).alias("digest"))
        n = -(-n // FANOUT)
    return levels


def tree_root(rows: DataFrame, leaf: Column, *order: Column) -> str:
    """The root's digest; that of an empty text for no rows."""
    levels = tree_levels(rows, leaf, *order)
    return levels[-1].first()["digest"] if levels else hashlib.sha256(b"").hexdigest()


def event_text(columns: list[str]) -> Column:
    """The canonical text of an event: its columns by name, in JSON, nulls included."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
