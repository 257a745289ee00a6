from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import decontam

from .conftest import prose


def plain(item, text):
    """Edits of the nearest substring."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=9), st.lists(st.integers(0, 4), max_size=14))
def test_edit_distance(item, text):
    got = decontam.edit_distance_within(np.array(item), np.array(text, np.int64), 99)
    assert got[0] == plain(item, text)
    near = decontam.edit_distance_within(np.array(item), np.array(text, np.int64), 2)
    assert (near is None) == (got[0] > 2)


def edited(words, n, r):
    out = list(words)
    for _ in range(n):
        k = r.randrange(len(out))
        what = r.random()
        if what < 0.4:
            out[k] = f"new{r.random():.4f}"
        elif what < 0.7:
            del out[k]
        else:
            out.insert(k, f"more{r.random():.4f}")
    return out


def test_recall_and_precision(spark):
    """Planted passages with up to a sixth of the words edited, against exact edit distance over all texts."""
    r = random.Random(4)
    items = [(k, " ".join(f"{x}{r.randrange(40)}" for x in prose(1000 + k, 16 + k % 45).split())) for k in range(60)]
    docs, planted = [], set()
    for k in range(300):
        text = prose(k, 150).split()
        if k % 2:
            i, said = items[k % 60]
            cut = said.split()
            at = r.randrange(150)
            text[at:at] = edited(cut, r.randrange(len(cut) // 6 + 1), r)
            planted.add((k, i))
        docs.append((k, " ".join(text)))
    docs += [(500, None), (501, ""), (502, items[0][1]), (502, items[0][1])]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (902, "a b")], "item_id long, text string")
    got = decontam.leaks(table, bench).collect()
    found = {(x["doc_id"], x["item_id"]) for x in got}
    true = {(d, i) for d, i in planted if plain(dict(items)[i].split(), dict(docs)[d].split()) <= int(decontam.MAX_EDITS * len(dict(items)[i].split()))}
    assert len(found & true) >= 0.98 * len(true)
    assert found - true <= {(502, 0)} and sum(x["doc_id"] == 502 for x in got) == 2
    assert all(x["edits"] == plain(dict(items)[x["item_id"]].split(), (dict(docs)[x["doc_id"]]).split()) for x in got[:40])


def test_short_items_and_text_ends(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "x y alpha beta gamma delta"), (3, "alpha beta gamma"), (4, "zero one two three four five six seven"), (5, "One TWO three four five six seven z")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontam.leaks(docs, items).collect())
    assert got == [(1, 1, 0), (2, 1, 0), (4, 2, 0), (5, 2, 0)]


def test_all_lengths_and_edits(spark):
    """Items of 1 to 20 words, every number of edits up to a fifth, at every offset to the stride: all are found."""
    r = random.Random(8)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    items = {n: fresh(n) for n in range(1, 21)}
    docs, planted = [], set()
    for n, item in items.items():
        for e in range(int(decontam.MAX_EDITS * n) + 1):
            for k in range(12):
                docs.append(fresh(20 + k) + edited(item, e, r) + fresh(30))
                planted.add((len(docs), n, plain(item, docs[-1])))
    table = spark.createDataFrame([(k + 1, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(i)) for n, i in items.items()], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"], x["edits"]) for x in decontam.leaks(table, bench).collect()} == planted


def test_nothing(spark, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontam.leaks(empty, one).collect() == [] and decontam.leaks(docs, none).collect() == []


def test_equal_windows_walk_alike_and_short_items_need_one_repetition():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 7, 15, 40):
        item = r.integers(1, 2**60, n).astype(np.uint64)
        text = np.concatenate([r.integers(1, 2**60, 9).astype(np.uint64), item, r.integers(1, 2**60, 9).astype(np.uint64)])
        kind = decontam.class_of(n)
        for rep in range(decontam.REPETITIONS):
            (a, passed), (b, _) = (decontam.walk_keys(h, s, rep, (kind,))[kind] for h, s in ((item, np.arange(n)), (text, np.arange(9, 9 + n))))
            assert passed[0] < n and (a[passed + np.arange(n) < n] == b[passed + np.arange(n) < n]).all()


def test_every_length_is_found_by_walks_at_the_most_edits():
    """Recall of the walks alone, a repetition at a time, with as many edits as an item may have."""
    r, missed, tried = random.Random(9), 0, 0
    for n in (5, 6, 8, 10, 12, 15, 16, 20, 25, 30, 45):
        for _ in range(30):
            item = [f"w{r.randrange(10**9)}" for _ in range(n)]
            doc = [f"w{r.randrange(10**9)}" for _ in range(7)] + edited(item, int(decontam.MAX_EDITS * n), r) + [f"w{r.randrange(10**9)}" for _ in range(20)]
            index = decontam.Index([(1, " ".join(item))])
            (_, _, h, _), = decontam.words(decontam.pa.array([" ".join(doc)]))
            tried += 1
            missed += not len(index.collisions(h, np.zeros(len(h), np.int64)))
    assert missed <= 0.01 * tried


def test_items_in_several_blocks(spark, monkeypatch):
    items = [(k, " ".join(prose(2000 + k, 14).split())) for k in range(12)]
    docs = spark.createDataFrame([(k, prose(k, 30) + " " + t + " " + prose(k + 50, 30)) for k, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(tuple, decontam.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 5)
    assert sorted(map(tuple, decontam.leaks(docs, bench).collect())) == once and len(once) >= 12


def test_a_text_of_megabytes(spark):
    item = " ".join(prose(77, 25).split())
    long = " ".join([prose(1, 200_000), item, prose(2, 200_000)])
    got = decontam.leaks(spark.createDataFrame([(1, long)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(x["doc_id"], x["item_id"], x["edits"]) for x in got] == [(1, 5, 0)]
