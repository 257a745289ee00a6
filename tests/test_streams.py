"""Logs of runs and streams, and redaction of new files."""

from __future__ import annotations

import json
import threading
import time

import pytest

from vellum.streaming.ingest import redact_stream
from vellum.streaming.logs import run_log, timed


def test_followers_see_lines_until_the_end_or_silence(tmp_path):
    logger, log = run_log(None, str(tmp_path / "run.log"), "vellum-a", waiting=5)
    with timed(logger, "ranking"):
        logger.debug("details")
    log.done()
    assert [x.split(" in ")[0] for x in log.follow()] == ["INFO ranking started", "INFO ranking done"]
    with pytest.raises(ZeroDivisionError), timed(logger, "audit"):
        1 / 0  # noqa: B018
    began = time.time()
    got = list(log.follow(idle=0.3))
    assert got[0] == "INFO audit started" and got[1].startswith("ERROR audit failed") and got[-1] == "[TIMEOUT]" and time.time() - began < 5
    kept = [json.loads(x) for x in (tmp_path / "run.log").read_text().splitlines()]
    assert [x["level"] for x in kept] == ["INFO", "DEBUG", "INFO", "INFO", "ERROR"] and "ZeroDivisionError" in kept[-1]["error"]


def test_a_full_queue_loses_the_oldest_lines_and_says_so(tmp_path):
    logger, log = run_log(None, str(tmp_path / "run.log"), "vellum-b", waiting=4, max_bytes=400)
    threads = [threading.Thread(target=lambda k=k: logger.info("line %d", k)) for k in range(20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log.done()
    got = list(log.follow())
    assert len(got) == 4 and got[-1] == "[17 lines lost]"
    assert 3 <= len(list(tmp_path.iterdir())) <= 6 and all(f.stat().st_size <= 400 for f in tmp_path.iterdir())
    run_log(None, None, "vellum-b")
    logger.info("once")
    assert len(logger.handlers) == 1


def test_streams_tell_their_progress_and_write_by_batch(spark, tmp_path):
    logger, log = run_log(spark, None, "vellum-c")
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run() -> None:
        redact_stream(spark, str(folder), out, str(tmp_path / "cp")).awaitTermination(120)

    (folder / "a.txt").write_text("mail a@b.example.com now")
    (folder / "b.txt").write_text("other: text")
    run()
    (folder / "c.txt").write_text("Mail  a@b.example.com NOW")
    (folder / "d.txt").write_text("third: text")
    run()
    got = spark.read.parquet(out)
    assert sorted((r["text"], r["batch"]) for r in got.collect()) == [("mail [EMAIL_REDACTED] now", 0), ("other: text", 0), ("third: text", 1)]
    # a batch that runs again, as after a failure before it was noted, leaves the table as it is
    import shutil

    for kind in ("commits", "offsets"):
        for f in (tmp_path / "cp" / kind).glob("*1*"):
            f.unlink() if kind == "commits" else None
        for f in (tmp_path / "cp" / kind).glob(".1*"):
            f.unlink() if kind == "commits" else None
    run()
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["mail [EMAIL_REDACTED] now", "other: text", "third: text"]
    shutil.rmtree(tmp_path / "in")
    deadline = time.time() + 20
    lines: list[str] = []
    while time.time() < deadline and sum("ended" in x for x in lines) < 3:
        lines += [x for x in log.follow(idle=1) if x != "[TIMEOUT]"]
    assert any("started" in x for x in lines) and any("batch 0: 2 rows" in x for x in lines) and sum("ended" in x for x in lines) == 3
    run_log(None, None, "vellum-c")
