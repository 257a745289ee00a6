"""Cohort retention against a plain loop."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

from vellum.llm import retention

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, salt int, n int"
EPOCH, WEEK = datetime(1970, 1, 1), timedelta(7)


def crc(x: int) -> int:
    return zlib.crc32(str(x).encode())


def plain(clicks, clients):
    out = defaultdict(lambda: [0, 0, 0, 0])
    starts, rows = [{}, {}], [[], []]
    for click, ts, arrived, client, kind, value, *_ in set(clicks):
        if ts is None or client is None:
            continue
        days = crc(click) % 100 if click is not None and crc(click) % 3 == 0 else 0
        early = arrived is not None and arrived + timedelta(days) < retention.CUTOFF
        for state in (0, 1) if early else (1,):
            rows[state].append((client, ts, 0 if value is None or value != value else int((100 * value + 0.5) // 1)))
            if kind == "error":
                starts[state][client] = min(starts[state].get(client, ts), ts)
    sources = defaultdict(set)
    for client, source in clients:
        sources[client] |= {source} - {None}
    week = lambda t: (t - EPOCH) // WEEK
    for state in (0, 1):
        money = defaultdict(int)
        for client, ts, cents in rows[state]:
            since = starts[state].get(client)
            if since is not None and ts >= since:
                money[client, (ts - since) // WEEK] += cents
        for (client, period), cents in money.items():
            since = starts[state][client]
            moved = all(client in s for s in starts) and week(starts[0][client]) != week(starts[1][client])
            cell = out[state, min(sources[client], default=""), week(since), period]
            for k, v in enumerate((1, crc(client), int(moved), cents)):
                cell[k] += v
    return {(*k, *v) for k, v in out.items()}


def rows(seed: int, n: int):
    r = random.Random(seed)
    out = []
    for k in range(n):
        ts = datetime(2023, 12, 25) + timedelta(microseconds=r.randrange(100 * 86_400_000_000))
        client = 7 if r.random() < 0.4 else r.choice((None, -3, *range(20, 60)))
        arrived = None if r.random() < 0.03 else ts + timedelta(seconds=r.randrange(3 * 86400))
        value = r.choice((None, float("nan"), -3.456, 0.005, round(r.random() * 100, 2)))
        click = None if r.random() < 0.02 else k
        ts = None if r.random() < 0.03 else ts
        # exactly seven days on from another event, and a microsecond before
        if out and out[-1][1] is not None and r.random() < 0.1:
            ts, client = out[-1][1] + WEEK - timedelta(microseconds=r.choice((0, 1))), out[-1][3]
        out.append((click, ts, arrived, client, r.choice(("error", "view", None, "Error")), value, r.choice((None, "{}")), 1, 2))
    return out + out[::5] + [(*x[:6], "other", *x[7:]) for x in out[:5]]


CLIENTS = [(7, "web"), (-3, None), (20, "crm"), (20, "app"), (20, None), (21, ""), (None, "web"), (9999, "web")]


def test_cells_equal_a_plain_loop_with_and_without_salts(spark):
    data = rows(1, 1500)
    clicks = spark.createDataFrame(data, CLICKS)
    clients = spark.createDataFrame([(*c, 1) for c in CLIENTS], "client_id long, source string, state int")
    want = plain(data, CLIENTS)
    for size in (4096, 50, 7):
        got = [tuple(x) for x in retention.retention(clicks, clients, group_rows=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want, size
    assert any(x[6] for x in want) and any(x[4] > 1 for x in want)


def test_a_hot_client_without_a_start_and_empty_tables(spark):
    data = [(k, datetime(2024, 1, 1) + timedelta(hours=k), datetime(2024, 1, 2), 7 if k % 2 else 8, "view" if k % 2 else "error", 1.0, None, 0, 0) for k in range(60)]
    clients = spark.createDataFrame([], "client_id long, source string")
    got = {tuple(x) for x in retention.retention(spark.createDataFrame(data, CLICKS), clients, group_rows=5).collect()}
    assert got == plain(data, []) and {x[5] for x in got} == {crc(8)}
    assert retention.retention(spark.createDataFrame([], CLICKS), clients).collect() == []
