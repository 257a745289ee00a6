"""Run tables: repeated keys, concurrent writers, transactions."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from vellum import schemas
from vellum.errors import StoreError
from vellum.sources.store import TABLES, Store, insert_or_ignore, upsert

RANK = schemas.RANKING_RESULTS


def rank(run: str, c: str | None, n: int, at: str | None = "t") -> tuple:
    return (run, c, n, 0.5, 0.1, 0.2, 0.3, None, "[]", "[]", None, at)


def test_upsert_of_repeated_keys(spark):
    kind = "a int, b string, first string, v int"
    old = spark.createDataFrame([(1, "x", "old", 1), (2, None, None, 2), (3, "z", "old", 3)], kind)
    new = spark.createDataFrame([(1, "x", "n1", 10), (1, "x", "n2", 11), (2, None, "n3", 20), (4, None, None, 40), (4, None, "n4", 41), (4, None, "n5", 42)], kind)
    got = sorted(map(tuple, upsert(old, new, ("a", "b"), ("first",)).collect()))
    assert got == [(1, "x", "old", 11), (2, None, "n3", 20), (3, "z", "old", 3), (4, None, "n4", 42)]
    # an order other than that of the rows
    seq = new.withColumn("seq", -F.col("v"))
    got = sorted(map(tuple, upsert(old, seq.repartition(3), ("a", "b"), ("first",), ("seq",)).collect()))
    assert got == [(1, "x", "old", 10), (2, None, "n3", 20), (3, "z", "old", 3), (4, None, "n5", 40)]
    got = sorted(map(tuple, insert_or_ignore(old, new, ("a", "b")).collect()))
    assert got == [(1, "x", "old", 1), (2, None, None, 2), (3, "z", "old", 3), (4, None, None, 40)]
    empty = spark.createDataFrame([], kind)
    assert upsert(empty, empty, ("a",)).collect() == [] and upsert(old, empty, ("a",)).count() == 3 and upsert(empty, new, ("a", "b")).count() == 3


def test_no_write_of_two_writers_is_lost(spark, tmp_path):
    root = str(tmp_path)
    Store(spark, root).create_run("R0")
    a, b = Store(spark, root), Store(spark, root)
    first, second = a.transaction(), b.transaction()
    with first as x, second as y:  # both have the same state before them; y commits first
        x.save("ranking_results", spark.createDataFrame([rank("R1", "c", 1)], RANK))
        y.save("ranking_results", spark.createDataFrame([rank("R1", "d", 2)], RANK))
    assert sorted(r["candidate_id"] for r in a.read("ranking_results").collect()) == ["c", "d"]


def test_a_writer_that_comes_second_does_its_work_again(spark, tmp_path):
    root = str(tmp_path)
    one = Store(spark, root)
    one.save("ranking_results", spark.createDataFrame([rank("R1", "c", 1)], RANK))
    claim, seen = one.append_entry, []

    def late(n, state, changed):
        if not seen:
            seen.append(n)
            Store(spark, root).save("ranking_results", spark.createDataFrame([rank("R1", "d", 2), rank("R1", "c", 7)], RANK))
        return claim(n, state, changed)

    one.append_entry = late
    one.save("ranking_results", spark.createDataFrame([rank("R1", "c", 9, "later")], RANK))
    assert sorted((r["candidate_id"], r["rank"], r["ranked_at"]) for r in one.read("ranking_results").collect()) == [("c", 9, "t"), ("d", 2, "t")]
    assert one.versions() == [1, 2, 3]
    # a write to another run comes first: nothing is done again
    seen.clear()
    folders = len(list((tmp_path / "data/ranking_results").iterdir()))

    def other(n, state, changed):
        if not seen:
            seen.append(n)
            Store(spark, root).save("ranking_results", spark.createDataFrame([rank("R2", "e", 1)], RANK))
        return claim(n, state, changed)

    one.append_entry = other
    one.save("ranking_results", spark.createDataFrame([rank("R1", "f", 3)], RANK))
    assert one.read("ranking_results").count() == 4 and len(list((tmp_path / "data/ranking_results").iterdir())) == folders + 2


def test_many_threads(spark, tmp_path):
    errors = []

    def work(k: int) -> None:
        try:
            s = Store(spark, str(tmp_path))
            s.create_run(f"R{k}")
            s.save("audit_events", spark.createDataFrame([("R", f"E{k}", "X", "m", None, "INFO", "d", "{}", "t")], schemas.AUDIT_EVENTS))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    s = Store(spark, str(tmp_path))
    assert not errors and s.versions() == list(range(1, 13))
    assert sorted(r["run_id"] for r in s.list_runs().collect()) == [f"R{k}" for k in range(6)]
    assert sorted(r["event_id"] for r in s.read("audit_events", "R").collect()) == [f"E{k}" for k in range(6)]


def test_transactions_are_whole_or_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    with pytest.raises(ZeroDivisionError), s.transaction() as t:
        t.save("ranking_results", spark.createDataFrame([rank("R1", "c", 1)], RANK))
        1 / 0  # noqa: B018
    assert s.versions() == []
    with pytest.raises(StoreError), s.transaction() as t:
        t.save("ranking_results", spark.createDataFrame([rank("R1", "c", 1)], RANK))
        t.save("ranking_results", spark.createDataFrame([rank(None, "c", 1)], RANK))
    assert s.versions() == [] and s.read("ranking_results").count() == 0
    with s.transaction() as t:
        t.save("ranking_results", spark.createDataFrame([rank("R1", "c", 1)], RANK))
        t.save("ranking_results", spark.createDataFrame([rank("R1", "c", 2, "u"), rank("R2", "c", 3)], RANK))
        t.change("ranking_results", "R2", lambda rows: rows.where("false"))
    assert [(r["run_id"], r["rank"], r["ranked_at"]) for r in s.read("ranking_results").collect()] == [("R1", 2, "t")]


def test_odd_run_ids_history_and_vacuum(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    odd = ["", "a/b=c", "Ü %41 ?*", "001", "1"]
    s.save("ranking_results", spark.createDataFrame([rank(r, "c", k) for k, r in enumerate(odd)], RANK))
    for k in range(24):
        s.save("ranking_results", spark.createDataFrame([rank("001", "c", 100 + k)], RANK))
    assert {r["run_id"]: r["rank"] for r in s.read("ranking_results").collect()} == {"": 0, "a/b=c": 1, "Ü %41 ?*": 2, "001": 123, "1": 4}
    assert [r["rank"] for r in s.read("ranking_results", "1").collect()] == [4]
    assert {r["rank"] for r in s.read("ranking_results", version=1).collect()} == {0, 1, 2, 3, 4}
    assert s.vacuum(keep=3) == 0 and s.vacuum(keep=3, older_than_s=0) > 10
    assert s.read("ranking_results").count() == 5 and s.read("ranking_results", "001", version=24).first()["rank"] == 122
    assert all(s.read(t) is not None for t in TABLES)
    with pytest.raises(StoreError):
        s.read("nothing")
