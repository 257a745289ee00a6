"""Hashed FTRL classifier."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from vellum.llm import classifier

WORD = re.compile(r"[^ \t-\r]+")


def shape(word: str) -> str:
    kinds = ["a" if c >= 128 or 97 <= c < 123 else "A" if 65 <= c < 91 else "9" if 48 <= c < 58 else chr(c) for c in word.encode()]
    return "".join(c for k, c in enumerate(kinds) if not k or kinds[k - 1] != c)


def grams(text: str) -> Counter:
    """Names of the n-grams of a text, without hashes."""
    words = [w.encode().lower() for w in WORD.findall(text)]
    shapes = [shape(w) for w in WORD.findall(text)]
    out = Counter(("w", w) for w in words) + Counter(("s", s) for s in shapes)
    out += Counter(("ww", *p) for p in zip(words, words[1:], strict=False)) + Counter(("ss", *p) for p in zip(shapes, shapes[1:], strict=False))
    for k, w in enumerate(words):
        far = next((d for d in range(1, classifier.ECHO + 1) if k >= d and words[k - d] == w), 0)
        out += Counter({("e", far): 1} if far else {})
    return out


def test_features_are_the_named_ngrams(corpus):
    texts = [t for _, t in corpus] + ["Aa aA AA!! x9 x99 ünï&&& of&&&", "a a a b a c d e f g h i b"]
    sizes, lengths = [], []
    for offsets, bucket, value in classifier.features(pa.array(texts)):
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            sizes.append(b - a)
            lengths.append(float((value[a:b] ** 2).sum()))
            assert len(set(bucket[a:b])) == b - a
    assert len(sizes) == len(texts)
    for text, got, length in zip(texts, sizes, lengths, strict=True):
        want = grams(text or "")
        assert abs(got - len(want)) <= 3 + len(want) ** 2 / classifier.BUCKETS  # hashes may meet
        assert length == 0 if not want else math.isclose(length, 1)


def test_one_update_by_hand():
    at, value = np.array([3, 9]), np.array([0.6, 0.8])
    model = classifier.fit([(at, value, 1), (at[:1], np.ones(1), 0)], updates=1)
    z, n, prior = Counter(), Counter(), 0.0
    for _ in range(classifier.LEAST_PASSES):
        for b, v, y in (([3, 9, "bias"], [0.6, 0.8, 1.0], 1), ([3, "bias"], [1.0, 1.0], 0)):
            free = {k: 0 if k == "bias" else classifier.L1 for k in b}
            weight = lambda k: 0.0 if abs(z[k]) <= free.get(k, classifier.L1) else -(z[k] - math.copysign(free.get(k, classifier.L1), z[k])) / ((classifier.BETA + math.sqrt(n[k])) / classifier.ALPHA + classifier.L2)
            w = {k: weight(k) for k in b}
            p = 1 / (1 + math.exp(-sum(w[k] * x for k, x in zip(b, v, strict=True)) - prior))
            for k, x in zip(b, v, strict=True):
                g = (p - y) * x
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / classifier.ALPHA * w[k]
                n[k] += g * g
    free = {"bias": 0}
    assert math.isclose(model.weights[3], weight(3)) and math.isclose(model.weights[9], weight(9)) and math.isclose(model.bias, weight("bias"))
    assert np.count_nonzero(model.weights) <= 2


def test_held_out_junk_is_found(spark):
    r = random.Random(6)
    words = [a + b for a in "bcdfgh" for b in ("ala", "ero", "imi", "oku")]
    junk = (lambda w: w + r.choice(("&&&", "###")), lambda w: w.upper() + "!!", lambda w: "bala")
    rows, labels = [], {}
    for k in range(600):
        bad = r.random() < 0.25
        kind = r.choice(junk) if bad else str
        rows.append((k, " ".join(kind(r.choice(words)) for _ in range(r.randrange(20, 80))), 9.0))
        labels[k] = int(not bad)
    docs = spark.createDataFrame([*rows, (None, None, 0.0), (9000, "", 0.0), (9000, "", 0.0), (9001, "bala " * 200_000, 0.0)], "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels.items(), (None, 1), (5000, None), (9000, 0)], "doc_id long, quality int")
    got = classifier.score_quality(docs, marks).collect()
    assert len(got) == 604 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got)
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got)
    held = [x["predicted"] == labels[x["doc_id"]] for x in got if x["held_out"] and x["doc_id"] < 600]
    assert np.mean(held) > 0.97
    assert len({x["score"] for x in got if x["doc_id"] == 9000}) == 1
    # held-out labels change nothing
    flipped = marks.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) as quality")
    assert {tuple(x) for x in classifier.score_quality(docs, flipped).collect()} == {tuple(x) for x in got}


def test_bounds_and_no_labels(spark, documents, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in classifier.score_quality(documents, none).collect()} == {0.5}
    assert classifier.score_quality(empty, none).collect() == []
    marks = spark.range(40).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    every = classifier.labelled(documents, marks).count()
    assert 0 < classifier.labelled(documents, marks, 10).count() < every
    assert classifier.train(documents, marks, values=500).weights.any()
