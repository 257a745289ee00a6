"""Cohort retention matrix: how many clients of each weekly cohort come back, and when.

A client's start is its earliest start event; its cohort is the week of that day, and its later events fall into periods of
seven days from the start. Every cell is told twice, as known at a cutoff (late arrivals missing) and as known in the end.

Events are dealt into groups of about GROUP_ROWS rows: clients by a hash, and a client with more rows than that over
several salts. Each group of events meets, in a cogroup, the starts and segments of its clients; a salted client's start
is replicated to each of its salts. There NumPy finds cohorts and periods. Clients that live in one group are reduced to
cells at once; those of salted clients go on by client, so that a second reduction counts each once.
"""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._stage import Scratch, ship

CUTOFF = datetime(2024, 2, 1)
START_KIND = "error"
#: Rows of a group, unless that makes more than MOST_GROUPS: then groups grow with the table.
GROUP_ROWS, MOST_GROUPS = 4096, 100_000
DAY = 86_400_000_000
WEEK = 7 * DAY
NEVER = np.iinfo(np.int64).max
#: Cents of a value above this in size are no money; the value counts as 0.
MOST_CENTS = 1e15
CELL = "state int, segment string, cohort long, period long, client_id long, users long, users_crc32 long, moved long, cents long"


def arrival(click_id: Column, arrived_at: Column) -> Column:
    """arrived_at; a third of the ids, by crc32, arrive up to 99 days later."""
    h = F.crc32(click_id.cast("string").cast("binary"))
    late = F.when(h % 3 == 0, h % 100).otherwise(F.lit(0)).cast("int")
    return arrived_at.cast("timestamp_ntz") + F.make_dt_interval(days=late)


def known_events(clicks: DataFrame, cutoff: datetime = CUTOFF, kind: str = START_KIND) -> DataFrame:
    """client_id, ts, early (known before the cutoff), starts, cents and deal of each different row with ts and client."""
    own = clicks.where("ts is not null and client_id is not null").distinct()
    at = arrival(F.col("click_id"), F.col("arrived_at"))
    early = F.when(F.col("click_id").isNull(), F.col("arrived_at").cast("timestamp_ntz")).otherwise(at) < F.lit(cutoff.isoformat(" ")).cast("timestamp_ntz")
    cents = 100 * F.col("value") + 0.5
    return own.select(
        F.col("client_id").cast("long").alias("client_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.coalesce(early, F.lit(False)).alias("early"),
        F.coalesce(F.col("kind") == kind, F.lit(False)).alias("starts"),
        F.when(F.abs(cents) <= MOST_CENTS, F.floor(cents)).otherwise(F.lit(0)).cast("long").alias("cents"),
        F.xxhash64("click_id", "ts", "value").alias("deal"),
    )


def client_starts(events: DataFrame, clients: DataFrame) -> DataFrame:
    """client_id, n (rows), early_start and start (null: none), segment and crc of each client."""
    found = events.groupBy("client_id").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("starts") & F.col("early"), F.col("ts"))).alias("early_start"), F.min(F.when(F.col("starts"), F.col("ts"))).alias("start")
    )
    segments = clients.where("client_id is not null").groupBy(F.col("client_id").cast("long").alias("client_id")).agg(F.min("source").alias("segment"))
    found = found.join(segments, "client_id", "left")
    return found.withColumn("segment", F.coalesce("segment", F.lit(""))).withColumn("crc", F.crc32(F.col("client_id").cast("string").cast("binary")))


def _micros(column: pa.ChunkedArray, null: int = NEVER) -> np.ndarray:
    return pc.fill_null(column.cast(pa.timestamp("us")).cast(pa.int64()), null).to_numpy()


def _sums(keys: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """First places of each different key, in order, and the sums of values there."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    return order[first], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def group_cells(events: pa.Table, starts: pa.Table) -> pa.Table:
    """Rows of CELL of one group; client_id is set for salted clients only."""
    names, parts = [f.split()[0] for f in CELL.split(", ")], []
    ids = starts["client_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    full, early = _micros(starts["start"])[order], _micros(starts["early_start"])[order]
    crc, salted = starts["crc"].to_numpy()[order], starts["salted"].to_numpy(zero_copy_only=False)[order]
    coded = starts["segment"].combine_chunks().dictionary_encode()
    segment = coded.indices.to_numpy()[order] if len(ids) else np.zeros(0, np.int64)
    moved = (early != NEVER) & (early // WEEK != full // WEEK)
    if len(ids) and events.num_rows:
        client = events["client_id"].to_numpy()
        at = np.minimum(np.searchsorted(ids, client), len(ids) - 1)
        ts, cents = _micros(events["ts"]), events["cents"].to_numpy()
        mine, known = ids[at] == client, events["early"].to_numpy(zero_copy_only=False)
        for state, start in ((0, early), (1, full)):
            pick = np.flatnonzero(mine & (ts >= start[at]) & (known if state == 0 else True))
            who, since = at[pick], start[at[pick]]
            place, (money,) = _sums((who, (ts[pick] - since) // WEEK), (cents[pick],))
            who, period = who[place], ((ts[pick] - since) // WEEK)[place]
            for alone in (False, True):
                rows = np.flatnonzero(salted[who] == alone)
                w, cohort = who[rows], start[who[rows]] // WEEK
                values = (np.ones(len(w), np.int64), crc[w], moved[w].astype(np.int64), money[rows])
                keys = (segment[w], cohort, period[rows], w if alone else np.zeros(len(w), np.int64))
                first, sums = _sums(keys, values)
                client_ids = pa.array(ids[w[first]]) if alone else pa.nulls(len(first), pa.int64())
                columns = [pa.array(np.full(len(first), state, np.int32)), coded.dictionary.take(pa.array(segment[w[first]])), pa.array(cohort[first]), pa.array(period[rows][first]), client_ids]
                parts.append(pa.Table.from_arrays(columns + [pa.array(s) for s in sums], names=names))
    empty = pa.schema([(n, pa.int32() if n == "state" else pa.string() if n == "segment" else pa.int64()) for n in names])
    return pa.concat_tables([p.cast(empty) for p in parts]) if parts else empty.empty_table()


def retention(clicks: DataFrame, clients: DataFrame, cutoff: datetime = CUTOFF, kind: str = START_KIND, group_rows: int = GROUP_ROWS) -> DataFrame:
    """state, segment, cohort, period, users, users_crc32, moved and cents of each cell with a user.

    clicks: click_id, ts, arrived_at, client_id, kind, value (more columns only tell rows apart); clients: client_id, source.
    Equal rows count once. A null click_id arrives when arrived_at says; a null arrived_at is known in the end only. A
    null, not finite or absurd (over MOST_CENTS) value is 0 cents. Of several sources of a client the least counts, null
    ones last. Times with a zone are taken in the session's. Events that start nothing and clients without any have no cell;
    empty tables give none.

    What is broadcast is a row for each salted client, fewer than MOST_GROUPS whatever the size of the table; to the driver
    goes one number.
    """
    spark = clicks.sparkSession
    ship(spark)
    tables = Scratch(spark)
    events = tables.write(known_events(clicks, cutoff, kind), "events")
    starts = tables.write(client_starts(events, clients), "starts")
    total = starts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(group_rows, -(-total // MOST_GROUPS))
    buckets = max(1, -(-total // limit))
    hot = F.broadcast(starts.where(F.col("n") > limit).select("client_id", F.ceil(F.col("n") / limit).cast("int").alias("salts")))
    bucket = F.pmod(F.xxhash64("client_id"), F.lit(buckets)).alias("bucket")
    salts = F.coalesce("salts", F.lit(1))
    dealt = events.join(hot, "client_id", "left").select(bucket, F.pmod(F.col("deal"), salts).alias("salt"), "client_id", "ts", "early", "cents")
    every = starts.where("start is not null").join(hot, "client_id", "left").select(
        bucket, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "client_id", "start", "early_start", "segment", "crc", F.col("salts").isNotNull().alias("salted")
    )
    met = dealt.groupBy("bucket", "salt").cogroup(every.groupBy("bucket", "salt")).applyInArrow(group_cells, CELL)
    cell = ("state", "segment", "cohort", "period")
    once = met.groupBy(*cell, "client_id").agg(F.sum("users").alias("users"), F.max("users_crc32").alias("one_crc32"), F.sum("users_crc32").alias("users_crc32"), F.max("moved").alias("one_moved"), F.sum("moved").alias("moved"), F.sum("cents").alias("cents"))
    alone = F.col("client_id").isNotNull()
    cells = once.groupBy(*cell).agg(
        F.sum(F.when(alone, 1).otherwise(F.col("users"))).alias("users"),
        F.sum(F.when(alone, F.col("one_crc32")).otherwise(F.col("users_crc32"))).alias("users_crc32"),
        F.sum(F.when(alone, F.col("one_moved")).otherwise(F.col("moved"))).alias("moved"),
        F.sum("cents").alias("cents"),
    )
    cells = tables.write(cells, "cells")
    tables.drop("events")
    tables.drop("starts")
    return cells
