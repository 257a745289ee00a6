"""Toxicity and class language model."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import classlm, toxicity

WORD = re.compile(r"[^ \t-\r]+")


def test_trees_learn_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = toxicity.boost(x[:2000], y[:2000]).margin(x[2000:])
    assert ((m > 0) == (y[2000:] > 0)).mean() > 0.95


def test_isotonic_is_monotone_and_calibrated():
    r = np.random.default_rng(2)
    m = r.normal(size=4000)
    p = 1 / (1 + np.exp(-2 * m))
    xs, ys = toxicity.isotonic(m, (r.random(4000) < p).astype(float))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) > 0).all()
    assert abs(np.interp(m, xs, ys) - p).mean() < 0.05


def test_held_out_toxic_rows_are_found(spark, documents):
    r = random.Random(5)
    words = [a + b for a in "bcdfgh" for b in ("ala", "ero", "imi", "oku")]
    rows, labels = [], []
    for k in range(700):
        toxic = r.random() < 0.2
        text = [r.choice(words) for _ in range(60)]
        for _ in range(4 if toxic else 0):
            text[r.randrange(60)] = r.choice(("idiot", "scum", "zorgfoo", "zorgbar", "1d10t"))
        rows.append((k, " ".join(text), 9.0))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None, 0.0), (9000, "", 0.0), (9000, "", 0.0)], "doc_id long, text string, score double")
    got = toxicity.score_toxicity(docs, spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")).collect()
    assert len(got) == 703 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got)
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got)
    held = [(x["score"], dict(labels)[x["doc_id"]], x["predicted"]) for x in got if x["held_out"] and x["doc_id"] < 700]
    a, b = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert np.mean([p > q for p in a for q in b]) > 0.95
    assert np.mean([p == y for _, y, p in held]) > 0.95


def test_toxicity_without_labels(spark, documents, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score_toxicity(documents, none).collect()} == {0}
    assert toxicity.score_toxicity(empty, none).collect() == []


def brute(rows):
    """n_tokens, n_known, N and base score of each text."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*WORD.findall((t or "").translate(low)), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = c.total(), len(c)
    return [(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows]


@pytest.mark.parametrize("head", [1 << 19, 16])
def test_base_equals_brute_force(documents, corpus, head):
    """A small head sends most words through the join by word."""
    got = classlm.score_documents(documents, most=head, clustered=8, classes=3).collect()
    key = lambda r: str(r[:3])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(corpus), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], abs_tol=1e-6)


def test_model_beats_base_on_held_out_text(spark):
    r = random.Random(3)
    groups = [[f"{c}{k}" for k in range(40)] for c in "abcd"]
    rows = [(k, " ".join(r.choice(groups[(k + j) % 4]) for j in range(80))) for k in range(300)]
    got = classlm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), clustered=170, classes=6).where("held_out").collect()
    assert sum(x["score"] for x in got) > 0.9 * sum(x["base_score"] for x in got) and len(got) > 20


def test_exchange_finds_the_groups():
    n, k = 41, 4
    m = np.zeros((n, n))
    for a in range(1, n):
        for b in range(1, n):
            m[a, b] = 50 if b % k == (a + 1) % k else 0.0
    cls = classlm.exchange(m, n, k)
    assert all(len({cls[w] for w in range(1, n) if w % k == g}) == 1 for g in range(k))


def test_probabilities_sum_to_one():
    g = np.random.default_rng(0).integers(0, 5, (6, 5)).astype(float)
    g[2] = 0
    assert np.allclose(np.exp(classlm.log_transitions(g)).sum(1), 1)


def test_words_that_are_no_seeds_join_their_groups(spark):
    """Few seeds score nearly as well as if the driver clustered all words. A head smaller than the vocabulary costs the
    context of what follows the words outside, and still beats the counts of words."""
    r = random.Random(5)
    groups = [[f"{c}{k}" for k in range(40)] for c in "abcd"]
    rows = [(k, " ".join(r.choice(groups[(k + j) % 4][: 8 if r.random() < 0.5 else 40]) for j in range(80))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sums = lambda **how: classlm.score_documents(docs, classes=4, **how).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    whole, base = sums(clustered=170)
    assert sums(clustered=33)[0] > 1.03 * whole > base and sums(clustered=33, most=100)[0] > base


def test_language_model_of_nothing(spark, empty):
    assert classlm.score_documents(empty).collect() == []
    one = spark.createDataFrame([(k, None) for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2][:1], "doc_id long, text string")
    row = classlm.score_documents(one).first()
    assert (row["train_tokens"], row["n_tokens"], row["n_known"]) == (0, 1, 0) and math.isclose(row["base_score"], 0.0, abs_tol=1e-9)


def test_words_outside_the_head_are_contexts_like_all_others(spark):
    """What follows a word outside the head is predicted from its class: a small head scores nearly as a whole one does."""
    r = random.Random(6)
    groups = [[f"{c}{k}" for k in range(120)] for c in "abcd"]
    rows = [(k, " ".join(r.choice(groups[(k + j) % 4][: 8 if r.random() < 0.5 else 120]) for j in range(80))) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda **how: classlm.score_documents(docs, classes=4, clustered=33, **how).where("held_out").selectExpr("sum(score)", "sum(n_known)").first()
    whole, small = score(), score(most=40)
    assert abs(small[0] - whole[0]) < 0.01 * abs(whole[0]) and small[1] == whole[1]


def test_one_long_text_takes_linear_time():
    words = ["you", "idiot", "plain", "words", "scum", "here", "and", "there"]
    r = random.Random(3)
    for n in (40, 400):
        hits, persons = sorted(r.sample(range(n), n // 5)), sorted(r.sample(range(n), n // 9))
        assert toxicity.beside(hits, persons) == sum(any(abs(k - p) <= toxicity.NEAR for p in persons) for k in hits)
    assert toxicity.beside([3], []) == toxicity.beside([30], [1]) == 0 and toxicity.beside([6], [1]) == toxicity.beside([1], [6]) == 1
    text = " ".join(r.choice(words) for _ in range(1_000_000))
    began = time.time()
    assert toxicity.features(text, toxicity.Lexicon())[6] > 0.1
    assert time.time() - began < 30


def test_fitted_texts_are_bounded_by_characters(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "word " * 50) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    every = len(toxicity.training_rows(docs, labels))
    monkeypatch.setattr(toxicity, "FIT_CHARS", 10_000)
    assert 0 < len(toxicity.training_rows(docs, labels)) <= 40 < every


def test_contexts_of_a_word_may_lie_in_several_batches():
    """Rows of contexts come by word, not collected into lists; where batches end changes nothing."""
    r = np.random.default_rng(4)
    g = r.integers(0, 9, (6, 5)).astype(float)
    h = np.sort(r.integers(0, 12, 300))
    rows = pa.RecordBatch.from_arrays([pa.array(h), pa.array(r.integers(0, 36 + 12, 300), pa.int32()), pa.array(r.integers(1, 5, 300))], names=["h", "x", "c"])
    told = lambda step: pa.Table.from_batches(list(classlm._assign(g, True)(rows.slice(k, step) for k in range(0, 300, step)))).to_pylist()
    assert told(300) == told(1) == told(7) == told(60) and [x["h"] for x in told(300)] == sorted(set(h.tolist()))
