"""The command line over a folder, and the stages that it leaves done."""

import json

import pytest

from vellum.__main__ import main
from vellum.functions.taxonomy import ALIASES, Taxonomy
from vellum.plans.outputs import STAGES, stage_status, write_screening
from vellum.plans.screening import Screening


def test_screen_and_status(spark, tmp_path, capsys):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    (raw / "a.txt").write_text("Skills\nPython, Docker\nmail a.person@example.com")
    (raw / "b.txt").write_text("just prose about nothing")
    (raw / "c.txt").write_text("  ")
    (tmp_path / "job.txt").write_text("We want Python and Docker")
    assert not any(s["done"] for s in stage_status(spark, str(out)).values())
    assert main(["screen", str(raw), str(out), "--job", str(tmp_path / "job.txt"), "--at", "2024-01-15", "--skip", "bias"]) == 0
    assert "Candidate_01" in capsys.readouterr().out
    done = {k: v["done"] for k, v in stage_status(spark, str(out)).items()}
    assert done == {k: k != "bias" for k in STAGES}
    ranking = spark.read.json(str(out / "ranking"))
    assert ranking.count() == 2 and ranking.orderBy("rank").first()["candidate_id"] == "Candidate_01"
    assert "example.com" not in "".join(r["text"] for r in spark.read.json(str(out / "anonymized")).collect())
    assert "text" not in spark.read.json(str(out / "vault")).columns
    assert [r["file_name"] for r in spark.read.json(str(out / "errors")).collect()] == ["c.txt"]
    events = spark.read.json(str(out / "events")).count()
    assert events > 0 and spark.read.json(str(out / "event_digests")).select("sha256").distinct().count() == events
    assert main(["status", str(out)]) == 0
    assert json.loads(capsys.readouterr().out)["parsing"]["done"]


def test_near_duplicates_are_told_and_not_ranked(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    text = "plain prose about nothing in particular, told at some length so that it fills a line or two of text"
    for name, said in (("a", text), ("b", text + "."), ("c", "other words altogether"), ("d", text.upper())):
        (raw / f"{name}.txt").write_text(said)
    (tmp_path / "job.txt").write_text("We want Python")
    told = ["screen", str(raw), str(out), "--job", str(tmp_path / "job.txt"), "--at", "2024-01-15"]
    assert main(told) == 0
    assert sorted(r["candidate_id"] for r in spark.read.json(str(out / "ranking")).collect()) == ["Candidate_01", "Candidate_03"]
    got = sorted((r["file_name"], r["detail"]) for r in spark.read.json(str(out / "errors")).where("kind = 'DUPLICATE'").collect())
    assert got == [("b.txt", "near-duplicate of Candidate_01"), ("d.txt", "near-duplicate of Candidate_01")]
    assert main([*told, "--keep-duplicates"]) == 0 and spark.read.json(str(out / "ranking")).count() == 4


def test_skipped_stages_do_no_work(spark, monkeypatch):
    from datetime import datetime

    from vellum.operators import audit, fairness
    from vellum.plans.screening import screen

    texts = spark.createDataFrame([("Candidate_01", "Skills\nPython", "a.txt")], "candidate_id string, text string, original_filename string")
    for module, name in ((audit, "event_log"), (audit, "gdpr_checks"), (fairness, "all_checks")):
        monkeypatch.setattr(module, name, lambda *a, **k: pytest.fail("a skipped stage ran"))
    run = screen(texts, "We want Python", Taxonomy(), datetime(2024, 1, 1), skip=("audit", "bias", "explainability"))
    assert run.ranking.count() == 1 and run.explanations is run.checks is run.events is run.gdpr is None
    run = screen(texts, "We want Python", Taxonomy(), datetime(2024, 1, 1), skip=("audit", "ranking"))
    assert run.ranking is run.explanations is run.checks is None and run.parsed.count() == 1


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace as N

    from vellum.session import shared_dir

    bare = lambda master, named=None: N(conf=N(get=lambda k, d: named), sparkContext=N(master=master, applicationId="x", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        shared_dir(bare("spark://host:7077"))
    assert shared_dir(bare("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"


def test_unknown_stage():
    with pytest.raises(ValueError):
        write_screening(Screening(None, None), "nowhere", ("cooking",))


def test_aliases():
    assert len(ALIASES) == 31
    names = Taxonomy({"tools": ["GitHub Actions"]}).spellings()
    assert names["gha"] == names["gh actions"] == ["GitHub Actions"]
