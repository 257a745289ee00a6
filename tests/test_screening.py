"""Rules and operators on literal rows."""

from __future__ import annotations

import io
import random
import zipfile
from datetime import date, datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vellum import schemas
from vellum.errors import EmptyQueryError, LeakError, ScreeningError
from tests.plain_parser import roles_of, sections_of, span_of
from vellum.functions import redact
from vellum.functions.explain import headline, highest_education, verdict, years
from vellum.functions.taxonomy import CV_GUARD, JOB_GUARD, Taxonomy, match_names
from vellum.functions.text import percent, rounded
from vellum.operators import audit, dedup, fairness, views
from vellum.operators.rank import global_rank, rank_candidates, score_candidates
from vellum.plans.queries import QUERIES
from vellum.plans.report import audit_report, bias_report, summary_report
from vellum.plans.screening import screen
from vellum.sources import readers, sinks, store
from vellum.streaming.ingest import redact_stream

AS_OF = date(2024, 1, 15)
CV = """Jane Doe
jane@mail.example.com, +1 (415) 555-2671
Summary
She builds data systems. See https://site.example.com/x
Skills
Python, SQL Server, Docker, Spring Boot
Experience
Engineer
Jan 2020 - Mar 2023
- 5 years experience with Kafka
Education
Master of Science in Computer Science, 2014 - 2016
Languages
English, German
"""


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_anonymize_keeps_a_vault(spark):
    row = redact.anonymize(spark.createDataFrame([("Candidate_01", CV), ("Candidate_02", None)], "candidate_id string, text string")).orderBy("candidate_id").first()
    text = row["text"]
    assert "Jane" not in text and "@mail" not in text and "555-2671" not in text and "[URL_REDACTED]" in text and "The Candidate builds" in text
    assert row["original_name"] == "Jane Doe" and row["contact_info"]["emails"] == ["jane@mail.example.com"]
    assert row["pii_categories_found"]["phones"] == 1 and row["techniques_applied"][0] == "contact_regex" and row["anonymization_level_used"] == "STRICT"


@pytest.mark.parametrize("level,kept", [("STRICT", False), ("MODERATE", True), ("MINIMAL", True), ("other", False)])
def test_entities_by_level(spark, level, kept):
    def tagger():
        return lambda text: [(text.index("France"), text.index("France") + 6, "GPE"), (text.index("Ann Lee"), text.index("Ann Lee") + 7, "PERSON"), (text.index("Python"), text.index("Python") + 6, "PERSON")]

    df = redact.start(spark.createDataFrame([("c", "Ann Lee went to France with Python")], "candidate_id string, text string"))
    got = redact.redact_entities(tagger, level if level in redact.LEVELS else "STRICT")(df).first()
    assert got["text"] == f"[c] went to {'France' if kept else '[LOCATION_REDACTED]'} with Python" and got["counts"] == {"ner_persons": 1}


def test_spans_do_not_overlap():
    assert redact.resolve_spans([(5, 9, "b"), (0, 6, "a"), (0, 3, "x"), (6, 8, "c")]) == [(0, 6, "a"), (6, 8, "c")]


def test_leaks(spark):
    got = one(spark, redact.validate(F.lit("a@b.example.com and 01/02/2020 and 415.555.2671 Ann Lee, Bob Ray, Dan Sun, Career Objective")))
    assert [x["type"] for x in got["leaks_found"]] == ["email", "phone", "full_date"] and got["confidence_score"] == 55.0 and not got["passed"]
    assert one(spark, redact.validate(F.lit("clean"))).asDict() == {"passed": True, "leaks_found": [], "confidence_score": 100.0}


def test_redaction_is_idempotent_on_its_tags(spark):
    df = spark.createDataFrame([("Candidate_01", CV)], "candidate_id string, text string")
    steps = dict(redact.steps())
    once = steps["urls"](steps["email"](redact.start(df)))
    assert steps["urls"](steps["email"](once)).first()["text"] == once.first()["text"]


@pytest.mark.parametrize("line,want", [("3 months", 3), ("6 mos", 72), ("5 motors", 60), ("5years", 60), ("Jan 2020 - Mar 2022", 26), ("2015 - Present", 108), ("2020 – 2019", 0), ("none", None)])
def test_durations(line, want):
    assert span_of(line, AS_OF)[1] == want


def test_roles_and_sections():
    roles, total, _ = roles_of("Lead\nJan 2020 - Jan 2021\n- did a\nprojects\nother 2019 - 2020", AS_OF)
    assert (total, [r["duration_months"] for r in roles]) == (24, [12, 12]) and roles[0]["description"] == "Lead did a"
    assert sections_of("x\ny") == {"summary": "x\ny"} and sections_of("Skills:\na\n\nEducation") == {"skills": "a", "education": "Education"}


@pytest.mark.parametrize("text,guard,names,want", [
    ("i know python.", CV_GUARD, ["Python"], []), ("python, sql", CV_GUARD, ["Python", "SQL"], ["Python", "SQL"]), ("c/c++ for c", CV_GUARD, ["C", "C++"], ["C", "C++"]),
    ("c++ dev", JOB_GUARD, ["C", "C++"], ["C", "C++"]), ("r&d", JOB_GUARD, ["R"], ["R"]), ("c++11", JOB_GUARD, ["C++"], []), ("python.", JOB_GUARD, ["Python"], ["Python"]),
    ("google cloud run spring boot", CV_GUARD, ["Google Cloud", "Cloud Run", "Spring", "Spring Boot"], ["Cloud Run", "Google Cloud", "Spring", "Spring Boot"]),
])
def test_guards(spark, text, guard, names, want):
    assert sorted(one(spark, match_names(F.lit(text), {n.lower(): [n] for n in names}, guard))) == want


def test_small_rules(spark):
    assert one(spark, percent(F.lit(0.125))) == "12%" and one(spark, rounded(F.lit(0.60125), 4)) == 0.6012
    assert [one(spark, verdict(F.lit(x))) for x in (0.75, 0.6, 0.45, 0.44)] == ["Strong Match", "Good Match", "Partial Match", "Weak Match"]
    assert one(spark, verdict(F.lit(0.75), "senior")) == "Good Match"
    assert [one(spark, years(F.lit(m))) for m in (0, 12, 18, 36)] == ["0 years", "1 year", "1.5 years", "3 years"]
    assert one(spark, headline(F.lit(1), F.lit(1), F.lit("Weak Match"), F.lit(0))).startswith("Ranked #1 — weak")
    entries = F.from_json(F.lit('[{"level":"B.Sc","field":"a"},{"level":"PhD","field":"b"},{"level":"PhD","field":"c"}]'), f"array<{schemas.EDUCATION}>")
    assert tuple(one(spark, highest_education(entries))) == ("PhD", "b")


def test_rank_is_a_permutation(spark):
    df = spark.range(1000).select(F.format_string("Candidate_%02d", "id").alias("candidate_id"), (F.col("id") % 7).cast("double").alias("raw"))
    got = global_rank(df, F.col("raw").desc(), F.col("candidate_id")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and [(-r["raw"], r["candidate_id"]) for r in got] == sorted((-r["raw"], r["candidate_id"]) for r in got)
    assert global_rank(df.limit(0), F.col("raw")).count() == 0


def test_missing_records_and_ties(spark):
    texts = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "x"), ("d", " ")], "candidate_id string, text string")
    parsed = spark.createDataFrame([("c", ["python"], 1.0)], "candidate_id string, skills array<string>, quality_score double")
    got = rank_candidates(score_candidates(texts, parsed, ["Python", "SQL"])).orderBy("rank").collect()
    assert [(r["candidate_id"], r["keyword_score"], r["quality_score"]) for r in got] == [("c", 0.5, 1.0), ("a", 0.0, 0.5), ("b", 0.0, 0.5)]
    assert got[0]["final_score"] == 0.5 and got[1]["missing_skills"] == ["Python", "SQL"]
    assert score_candidates(texts, parsed, []).first()["kw"] == 0.0


def test_fairness_edges(spark):
    empty = spark.createDataFrame([], schemas.RANKING)
    got = {r["check_id"]: r for r in fairness.all_checks(empty, empty, spark.createDataFrame([], "candidate_id string, total_experience_months int")).collect()}
    assert len(got) == 7 and not any(r["flagged"] for r in got.values()) and got["score_distribution"]["note"] == "No scores available."
    rows = [(c, s, 0.9, 0.1, 0.5, [], ["x"], 1, k) for k, (c, s) in enumerate((("a", 0.5), ("b", 0.45), ("c", 0.41)), 1)]
    r = spark.createDataFrame(rows, schemas.RANKING)
    months = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "candidate_id string, total_experience_months int")
    got = {x["check_id"]: x["flagged"] for x in fairness.all_checks(r, months, months).collect()}
    assert got == {"score_distribution": False, "score_compression": True, "skill_gap_disparity": True, "semantic_keyword_gap": True, "experience_correlation": False, "quality_score_spread": False, "parsed_coverage": False}


def test_greedy_dedup_equals_the_sequential_rule(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards mix jugs of black quartz near the old mill road "
    texts = {1: base * 3, 2: base * 3 + "x", 3: "something else entirely " * 9, 4: (base * 3).upper(), 5: base * 2, 6: "", 7: base * 3 + "a tail that grows a bit more each time"}
    squeeze = lambda t: " ".join(t.lower().split())
    kept, want = [], {}
    for k, t in texts.items():
        if t.strip():
            hit = next((j for j in kept if SequenceMatcher(None, squeeze(t), squeeze(texts[j])).ratio() >= dedup.THRESHOLD), None)
            want[k] = hit
            kept += [k] if hit is None else []
    df = spark.createDataFrame(list(texts.items()), "key long, text string").where("text != ''")
    for lsh in (False, True):
        got = {r["key"]: r["duplicate_of"] for r in dedup.greedy_keep(df, dedup.near_duplicate_pairs(df, lsh=lsh)).collect()}
        assert got == want


def test_registered_near_dedup_is_exact(spark, tmp_path):
    """Three words with a changed letter, and 18 with a letter changed in every other word, share no word shingle."""
    r = random.Random(5)
    long = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(18)]
    texts = ["alphabetical ordering principles", "alphabetical orderimg principles", " ".join(long), " ".join(w if k % 2 else w[:4] + "z" + w[5:] for k, w in enumerate(long)), "other"]
    squeeze = lambda t: " ".join(t.lower().split())
    want = {k: next((j for j in range(k) if SequenceMatcher(None, squeeze(t), squeeze(texts[j])).ratio() >= dedup.THRESHOLD), None) for k, t in enumerate(texts)}
    assert list(want.values()) == [None, 0, None, 2, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["key"]: r["duplicate_of"] for r in QUERIES["near_dedup"](spark, str(tmp_path)).collect()} == want


def test_whole_run_and_reports(spark, tmp_path):
    texts = spark.createDataFrame([("Candidate_01", CV, "a.txt"), ("Candidate_02", "just prose about nothing", "b.txt")], "candidate_id string, text string, original_filename string")
    run = screen(texts, "We want Python, Docker and SQL Server", Taxonomy(), datetime(2024, 1, 15))
    first = run.ranking.orderBy("rank").first()
    assert first["candidate_id"] == "Candidate_01" and set(first["matched_skills"]) | set(first["missing_skills"]) == {"Docker", "Python", "SQL Server"}
    events = run.events.orderBy("n").collect()
    assert [e["event_id"] for e in events] == [f"EVT_{k:03d}" for k in range(1, len(events) + 1)] and events[0]["event_type"] == "PIPELINE_START" and events[-1]["event_type"] == "PIPELINE_COMPLETE"
    assert "Candidate_01" in summary_report(run.explanations) and "PASS" in audit_report(run.events, run.gdpr, audit.event_summary(run.events), "R") and "Flags raised" in bias_report(run.checks)
    assert views.filter_verdict(run.explanations).count() == 2 and audit.compliance(run.gdpr).first()["overall_compliant"]
    sinks.write_csv(run.explanations, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    rows = store.candidate_rows("R", run.vault.withColumn("validation_score", F.col("validation_score")).drop("text"), run.parsed, "t").count()
    assert rows == 2
    with pytest.raises(EmptyQueryError):
        screen(texts, " ", Taxonomy(), datetime(2024, 1, 15))
    alone = screen(texts, None, Taxonomy(), datetime(2024, 1, 15))
    assert alone.ranking is None and alone.events.where("event_type = 'CANDIDATE_RANKED'").count() == 0


def docx(text: str) -> bytes:
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_readers(spark, tmp_path):
    files = {"a.txt": b"hello", "b.TXT": b"  ", "c.docx": docx("one\ntwo"), "d.doc": b"x", "e.docx": b"broken", "f.txt": b"\xff\xfe\x00", "g.png": b"x"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["file_name"]: r for r in readers.with_candidate_ids(readers.read_documents(spark, str(tmp_path))).collect()}
    assert {k: v["status"] for k, v in got.items()} == {"a.txt": "OK", "b.TXT": "SKIPPED", "c.docx": "OK", "d.doc": "FAILED", "e.docx": "FAILED", "f.txt": "FAILED"}
    assert got["c.docx"]["text"] == "one\ntwo" and got["c.docx"]["candidate_id"] == "Candidate_03" and "Legacy" in got["d.doc"]["error"]
    assert readers.count_files(spark, str(tmp_path)) == 5 and readers.count_files(spark, str(tmp_path / "none")) == 0
    assert sinks.error_lines(readers.read_documents(spark, str(tmp_path))).count() == 4
    (tmp_path / "json").mkdir()
    (tmp_path / "json/x.json").write_text('{"rank": 1}')
    (tmp_path / "json/y.json").write_text("{oops")
    assert [tuple(r) for r in readers.read_records(spark, str(tmp_path / "json"), "candidate_id string, rank int").collect()] == [("x", 1)]
    assert readers.read_job(spark, str(tmp_path / "f.txt"))


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    s.create_run("R1", "jd.txt", "x" * 3000, "2024-01-01")
    s.create_run("R1", "other", "y", "2025-01-01")
    s.create_run("R2", at="2024-02-01")
    s.finish_run("R1", 0, 3, at="z")
    run = s.get_run("R1").first()
    assert (run["status"], run["total_cvs"], len(run["jd_text"]), run["jd_file"]) == ("completed", 3, 2000, "jd.txt") and s.list_runs(1).first()["run_id"] == "R2"
    rank = lambda c, score, at: (c, score, 0.1, 0.2, 0.3, ["a"], [], 1, 1, at)
    for score, at in ((0.5, "first"), (0.9, "second")):
        df = spark.createDataFrame([rank("c1", score, at)], schemas.RANKING + ", at string")
        s.save("ranking_results", store.ranking_rows("R1", df.drop("at"), None, at))
    got = s.rankings("R1").collect()
    assert len(got) == 1 and (got[0]["final_score"], got[0]["ranked_at"], got[0]["matched_skills"], got[0]["verdict"]) == (0.9, "first", ["a"], None)
    checks = spark.createDataFrame([("k", "L", True, "FLAGGED", "n", "{}")], "check_id string, label string, flagged boolean, status string, note string, detail string")
    s.save("bias_checks", store.check_rows("R1", checks, "t"))
    stats = views.dashboard_stats(s.read("pipeline_runs"), s.read("ranking_results"), s.read("bias_checks"), "R1").first()
    assert (stats["top_candidate"], stats["flags_raised"], stats["run_status"]) == ("c1", 1, "completed")
    events = spark.createDataFrame([("EVT_001", "t", "main", "X", None, "d", "lb", "INFO", "{}")], schemas.EVENT)
    for _ in range(2):
        s.save("audit_events", store.event_rows("R1", events))
    assert s.read("audit_events").count() == 2


def test_stream_adds_each_text_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, name in enumerate(("a", "b", "c")):
        (folder / f"{name}.txt").write_text("mail a@b.example.com" if name != "c" else "other text: more")
        redact_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["mail [EMAIL_REDACTED]", "other text: more"]


def test_errors():
    e = LeakError("found", leaks=["email"], confidence=85.0, stage="redact", candidate_id="c")
    assert isinstance(e, ScreeningError) and str(e) == "found (stage=redact, candidate=c)" and e.leaks == ["email"]


def test_queries_keep_no_text_beside_what_they_read(spark):
    from vellum.plans.queries import Run

    run = Run(spark, "/root/testdata/sf0.001")
    sections = run.parsed.schema["sections"].dataType.names
    assert "summary" not in sections and {"skills", "experience", "total_experience_months", "education", "certifications", "languages"} <= set(sections)
    assert run.parsed.where("quality_score > 0").count() > 0
