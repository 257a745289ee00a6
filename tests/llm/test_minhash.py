from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from vellum.llm import minhash
from vellum.llm._stage import Scratch

WORD = re.compile(r"[^ \t-\r]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(doc_id, n, component, kept) of each row by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        least = min(ids) if sets[k] and ids else i
        out.append((i, len(sets[k]), least, i == least))
    return sorted(out, key=str)


def test_equals_all_pairs(documents, corpus):
    got = sorted((tuple(r) for r in minhash.near_duplicates(documents).collect()), key=str)
    assert got == brute(corpus)


def test_empty(empty):
    assert minhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_both_ways(spark, few):
    links = [(k, k + 1) for k in range(0, 30)] + [(100, 120), (100, 110), (110, 130), (5, 200)]
    got = {r["node"]: r["root"] for r in minhash.components(spark.createDataFrame(links, "a long, b long"), few).collect()}
    assert got == {**{k: 0 for k in range(31)}, 200: 0, **{k: 100 for k in (100, 110, 120, 130)}}


def test_stars_bound_edges(spark):
    members = spark.createDataFrame([(1, n) for n in range(500)] + [(2, 7)], "key long, node long")
    assert minhash._stars(minhash._centred(members)).count() <= 2 * 500


def test_settled_members_meet_the_rest(spark):
    """In one bucket: a node is similar to another that the centre has already settled, and to no centre."""
    shifted = [" ".join(f"w{n}" for n in range(k, k + 104)) for k in (0, 12, 24, 36)]
    texts = [*shifted, *(" ".join(f"{c}{n}" for n in range(104)) for c in "pq")]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    kinds = own.withColumn("text_hash", F.xxhash64("text")).mapInArrow(minhash._sketch, minhash.SETS).select(F.col("rid").alias("node"), "s1", "s2")
    nodes = [r["node"] for r in kinds.collect()]
    centred = minhash._centred(spark.createDataFrame([(1, n) for n in nodes], "key long, node long"))
    with Scratch(spark) as scratch:
        links = {(r["a"], r["b"]) for r in minhash._links(own, kinds, centred, scratch).collect()}
    assert links == {(nodes[k], nodes[k + 1]) for k in range(3)}
