from __future__ import annotations

import pytest

import corpus_pipeline as pipeline
from vellum.llm import minhash, quality

from .conftest import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of a small corpus with one case for each stage."""
    out = str(tmp_path_factory.mktemp("sf"))
    item = prose(5000, 30)
    rows = [(k, prose(k, 120)) for k in range(30)]
    rows += [(50, prose(3, 120)), (51, prose(4, 120) + " changed"), (60, "too short"), (61, None), (62, "again " * 100)]
    rows += [(70, prose(71, 60) + " " + item + " " + prose(72, 60)), (80, prose(81, 80) + " mail me at a.b@c.example.com today"), (80, prose(81, 80) + " mail me at a.b@c.example.com today")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_act_and_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "encode":
            assert out.columns == columns
        rows = out.collect()
        ids.append({r["doc_id"] for r in rows})
        assert len(rows) == len(ids[-1]) or name == "quality_rules"
        docs = spark.createDataFrame(rows, out.schema)
    clean = set(range(30))
    assert ids[0] == clean | {50, 51, 70, 80}
    assert ids[1] == clean | {70, 80}
    assert ids[2] == ids[3] == ids[4] == clean | {80}


def test_run(spark, folder):
    got = {r["doc_id"]: r for r in pipeline.run(spark, folder).collect()}
    assert set(got) == set(range(30)) | {80}
    assert all(r["round_trip"] and r["n_pieces"] for r in got.values())


def test_stage_one_agrees_with_the_operator(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = [r["doc_id"] for r in quality.judge_quality(docs, labels).where("kept").collect()]
    assert sorted(r["doc_id"] for r in pipeline.quality_rules(spark, docs, folder).collect()) == sorted(kept)


def test_repeated_ids_leave_one_row(spark, folder):
    docs = spark.createDataFrame([(1, prose(1, 50)), (1, prose(1, 50)), (2, prose(1, 50)), (3, prose(2, 50)), (None, prose(9, 50))], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in pipeline.near_dedup(spark, docs, folder).collect()) == [0, 1, 3]
    assert minhash.near_duplicates(docs).where("kept").count() == 4


def test_unlike_texts_with_one_id_are_judged_apart(spark, folder):
    u = {k: prose(900 + k, 60) for k in (3, 5, 70, 71, 80)}
    rows = [(3, u[3]), (5, u[5]), (5, u[3]), (7, u[70]), (7, u[71]), (None, u[80]), (None, u[3]), (9, None), (9, None), (9, ""), (7, u[71])]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, vellum_0 int")
    got = [(r["doc_id"], r["text"]) for r in pipeline.near_dedup(spark, docs, folder).collect()]
    want = [(3, u[3]), (5, u[5]), (7, u[70]), (7, u[71]), (None, u[80]), (9, None), (9, None), (9, "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_leak_takes_its_row_alone(spark, folder):
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    rows = [(1, prose(1, 40)), (1, prose(2, 40) + " " + item), (None, item), (None, prose(4, 40)), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in pipeline.decontaminate(spark, docs, folder).collect()]
    assert sorted(got, key=repr) == sorted([rows[0], rows[3], rows[4]], key=repr)


@pytest.mark.parametrize("stage", [s for s, _ in pipeline.STAGES])
def test_stages_take_an_empty_table(spark, folder, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert dict(pipeline.STAGES)[stage](spark, docs, folder).count() == 0
