"""Audit digest, point lookup, injected encoders and key phrases."""

from __future__ import annotations

import hashlib
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum import schemas
from vellum.functions.taxonomy import Taxonomy
from vellum.operators import embed
from vellum.operators.digest import FANOUT, event_text, tree_levels, tree_root
from vellum.sources import readers, sinks

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def plain_root(texts: list[str]) -> str:
    level = [sha("0:" + t) for t in texts]
    while len(level) > 1:
        level = [sha("1:" + "".join(level[k : k + FANOUT])) for k in range(0, len(level), FANOUT)]
    return level[0] if level else sha("")


def test_tree_equals_a_plain_one_and_tells_changes(spark):
    for n in (0, 1, 2, FANOUT, FANOUT + 1, 700):
        df = spark.range(n).withColumn("said", F.concat(F.lit("event "), F.col("id"))).repartition(5)
        assert tree_root(df, F.col("said"), F.col("id")) == plain_root([f"event {k}" for k in range(n)])
    df = spark.range(700).withColumn("said", F.concat(F.lit("event "), F.col("id")))
    assert [level.count() for level in tree_levels(df, F.col("said"), F.col("id"))] == [700, 3, 1]
    changed = df.withColumn("said", F.when(F.col("id") == 699, "Event 699").otherwise(F.col("said")))
    assert tree_root(changed, F.col("said"), F.col("id")) != tree_root(df, F.col("said"), F.col("id"))
    # one leaf is no node, so a tree can't pass for a leaf of another
    assert tree_root(df.limit(1), F.col("said"), F.col("id")) == sha("0:event 0")


def test_audit_is_written_and_verified(spark, tmp_path):
    rows = [(k, f"EVT_{k:03d}", "2024-01-01T00:00:00", "main", "X", None if k % 2 else f"Candidate_{k:02d}", f'said "{k}" é', "law", "WARNING" if k == 3 else "INFO", "{}") for k in range(1, 301)]
    events = spark.createDataFrame(rows, "n int, " + schemas.EVENT).repartition(4)
    gdpr = spark.createDataFrame([(1, "Art. 5", "Principles", True, "evidence")], "ord int, article string, title string, satisfied boolean, evidence string")
    root = sinks.write_audit(events, gdpr, str(tmp_path), "RUN_1")
    names = ["n", *(f.split()[0] for f in schemas.EVENT.split(", "))]
    texts = [json.dumps({c: r[names.index(c)] for c in sorted(names)}, separators=(",", ":"), ensure_ascii=False) for r in rows]
    assert root == plain_root(texts)
    assert sinks.verify_audit(spark, str(tmp_path))
    assert f"SHA-256: {root}" in "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "audit_report")).collect())
    assert spark.read.text(str(tmp_path / "audit_log.sha256")).first()["value"] == f"{root}  audit_log.json"
    part = next(p for p in (tmp_path / "events").iterdir() if p.suffix == ".json" and '"EVT_007"' in p.read_text())
    part.write_text(part.read_text().replace('said \\"7\\"', 'said \\"8\\"'))
    for crc in (tmp_path / "events").glob(".*.crc"):
        crc.unlink()
    assert not sinks.verify_audit(spark, str(tmp_path))


def test_lookup_reads_one_bucket(spark, tmp_path):
    schema = "candidate_id string, quality_score double"
    df = spark.range(2000).selectExpr("concat('Candidate_', id) as candidate_id", "cast(id as double) / 2 as quality_score")
    sinks.write_lookup(df.unionByName(df.where("candidate_id = 'Candidate_5'")), str(tmp_path / "t"), 16)
    found = readers.lookup(spark, str(tmp_path / "t"), schema, "Candidate_77", 16)
    assert [tuple(r) for r in found.collect()] == [("Candidate_77", 38.5)]
    plan = found._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "PartitionFilters: [isnotnull(lookup_bucket" in text and "PushedFilters: [IsNotNull(candidate_id), EqualTo(candidate_id,Candidate_77)]" in text
    assert readers.lookup(spark, str(tmp_path / "t"), schema, "Candidate_5", 16).count() == 2
    own = spark.range(1).select(sinks.lookup_bucket(F.lit("Candidate_77"), 16)).first()[0]
    others = [f for f in (tmp_path / "t").glob("lookup_bucket=*/*.parquet") if f.parent.name != f"lookup_bucket={own}"]
    assert readers.lookup(spark, str(tmp_path / "t"), schema, "nobody", 16).collect() == readers.lookup(spark, str(tmp_path / "t"), schema, None, 16).collect() == []
    for f in others:  # no other folder is read
        f.write_bytes(b"broken")
        f.with_name(f".{f.name}.crc").unlink()
    assert len(others) >= 15 and readers.lookup(spark, str(tmp_path / "t"), schema, "Candidate_77", 16).count() == 1


def counting(folder: str):
    """An encoder of letter counts; each load leaves a file named after its process."""

    def load():
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write("x")

        def encode(texts):
            assert len(texts) <= embed.BATCH
            if any("boom" in t for t in texts):
                raise RuntimeError("model failed")
            return np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float)

        return encode

    return load


def test_encoder_is_loaded_once_a_worker(spark, tmp_path):
    encoder = embed.Encoder(f"letters-{tmp_path}", counting(str(tmp_path)))
    texts = [(f"c{k}", f"{'abc' * (k % 5)} words {k}") for k in range(500)] + [("null", None), ("empty", "")]
    df = spark.createDataFrame(texts, "candidate_id string, text string").repartition(12)
    for _ in range(2):
        got = {r["candidate_id"]: r["semantic_score"] for r in embed.encoded_scores(df, "abc words", encoder).collect()}
    vector = lambda t: np.array([t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"], float)
    job = vector("abc words")
    for name, text in texts[:40]:
        assert abs(got[name] - vector(text) @ job / np.linalg.norm(vector(text)) / np.linalg.norm(job)) < 1e-12
    assert got["null"] == got["empty"] == 0 and len(got) == 502
    assert {p.read_text() for p in tmp_path.iterdir()} == {"x"}


def test_failing_encoders_give_the_default(spark, tmp_path):
    df = spark.createDataFrame([("a", "fine"), ("b", "boom")], "candidate_id string, text string").repartition(2, "candidate_id")
    encoder = embed.Encoder(f"failing-{tmp_path}", counting(str(tmp_path)))
    assert {r["semantic_score"] for r in embed.encoded_scores(df, "boom", encoder).collect()} == {0.5}
    assert {r["semantic_score"] for r in embed.encoded_scores(df, "job", None).collect()} == {0.5}
    got = {r["candidate_id"]: r["semantic_score"] for r in embed.encoded_scores(df.coalesce(1).where("candidate_id = 'b'").unionByName(df.where("candidate_id = 'a'")), "fine", encoder).collect()}
    assert got["b"] == 0.5 and got["a"] == pytest.approx(1.0)


def plain_mmr(vectors, whole, most, diversity):
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if np.linalg.norm(a) * np.linalg.norm(b) > 0 else 0.0
    chosen: list[int] = []
    while len(chosen) < min(most, len(vectors)):
        worth = lambda k: cos(vectors[k], whole) if not chosen else (1 - diversity) * cos(vectors[k], whole) - diversity * max(cos(vectors[k], vectors[j]) for j in chosen)
        chosen.append(max((k for k in range(len(vectors)) if k not in chosen), key=lambda k: (round(worth(k), 9), -k)))
    return chosen


def test_phrases_by_maximal_marginal_relevance(spark, tmp_path):
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 50):
        vectors, whole = r.normal(size=(n, 6)), r.normal(size=6)
        assert embed.diverse(vectors, whole, 30, 0.5) == plain_mmr(vectors, whole, 30, 0.5)
    assert embed.phrase_candidates("The Big, big data of x data!", frozenset(("the", "of"))) == ["big", "big big", "big data", "data", "data data"]
    words = random.Random(4).choices(["python", "spark", "machine", "learning", "the", "node", "js", "go"], k=60)
    df = spark.createDataFrame([("a", " ".join(words)), ("b", None), ("c", " ")], "candidate_id string, text string")
    encoder = embed.Encoder(f"phrases-{tmp_path}", counting(str(tmp_path)))
    got = {x["candidate_id"]: x["phrases"] for x in embed.key_phrases(df, encoder, frozenset(("the",)), 12).collect()}
    found = embed.phrase_candidates(" ".join(words), frozenset(("the",)))
    assert got["b"] == got["c"] == [] and len(got["a"]) == 12 and set(got["a"]) <= set(found)


def test_phrases_add_names_that_are_not_there_yet(spark):
    taxonomy = Taxonomy({"technical": ["Python", "Spark", "Node.js"], "tools": ["Jira", "Python"]}, {"nodejs": "Node.js", "py": "Python"})
    skills = spark.createDataFrame([("a", {"technical": ["Spark"], "tools": []}), ("b", {"technical": [], "tools": ["Python"]}), ("c", {"technical": [], "tools": []})], "candidate_id string, skills map<string,array<string>>")
    phrases = spark.createDataFrame([("a", ["nodejs", "spark", "jira", "other words", "py", "node.js"]), ("b", ["python"])], "candidate_id string, phrases array<string>")
    got = {x["candidate_id"]: x["skills"] for x in embed.merge_phrases(skills, phrases, taxonomy).collect()}
    assert got == {"a": {"technical": ["Spark", "Node.js", "Python"], "tools": ["Jira"]}, "b": {"technical": [], "tools": ["Python"]}, "c": {"technical": [], "tools": []}}
