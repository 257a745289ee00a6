"""Filtering Lloyd against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from vellum.llm import codes


def test_filtering_equals_all_distances():
    r = np.random.default_rng(3)
    for d, n, spread, k in ((1, 300, 5, 9), (3, 2000, 40, 60), (16, 1500, 900, 256), (4, 500, 2, 30), (2, 40, 2**26, 9)):
        points = r.integers(-spread, spread + 1, (n, d))
        points[: n // 3] = points[0]  # many equal vectors
        entries = np.concatenate([points[: k // 2], r.integers(-spread, spread + 1, (k - k // 2, d))])
        distance = ((points[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        want = np.argmin(distance.astype(np.int64), 1)
        tree = codes.build(points)
        code, sums, counts = codes.assign(tree, points, entries)
        assert (code == want).all()
        assert (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[e] == points[want == e].sum(0)).all() for e in range(k))
        assert (tree.total[0] == points.sum(0)).all() and sorted(tree.order) == list(range(n))


def test_most_entries_go_before_the_leaves():
    r = np.random.default_rng(4)
    points = (r.normal(size=(40, 1, 3)) * 10_000 + r.normal(size=(40, 200, 3)) * 50).reshape(-1, 3).astype(np.int64)
    tree, entries = codes.build(points), points[::200]
    left = [len(codes.survivors(tree.lo[k], tree.hi[k], entries, np.arange(40))) for k in np.flatnonzero(tree.right == 0)]
    assert np.mean(left) < 3


def plain(vectors, parts, entries, rounds):
    """(id, code, error) by all distances, over Python integers."""
    kept = sorted((i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in vectors)
    d = len(kept[0][1]) // parts
    firsts = {}
    for i, v in kept:
        firsts.setdefault(i, v)
    out = {k: ["", 0] for k in range(len(kept))}
    for p in range(parts):
        own = [v[p * d : (p + 1) * d] for _, v in kept]
        book = [v[p * d : (p + 1) * d] for v in list(firsts.values())[:entries]]
        for last in [False] * rounds + [True]:
            near = [min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book)) for v in own]
            if not last:
                book = [[sum(c) // len(c) for c in zip(*m, strict=True)] if (m := [v for v, (_, k) in zip(own, near, strict=True) if k == e]) else old for e, old in enumerate(book)]
        for row, (distance, k) in enumerate(near):
            out[row][0] += f"{k:02x}"
            out[row][1] += distance
    return sorted((kept[k][0], *v) for k, v in out.items())


def test_codes_equal_plain_lloyd(spark):
    r = np.random.default_rng(5)
    good = [(int(i), [float(x) for x in r.normal(size=8).astype(np.float32)]) for i in r.permutation(120)]
    good += [(good[0][0], good[0][1]), (good[1][0], good[2][1])] + [(500 + k, good[3][1]) for k in range(40)]
    nan, inf = float("nan"), float("inf")
    bad = [(-5, None), (-4, [0.1] * 7 + [None]), (-3, [nan] * 8), (-2, [inf] + [0.0] * 7), (-1, []), (900, [0.5] * 4), (901, [1e30] * 8)]
    rows = [(i, v, None if k % 7 == 0 else k % 3, "x", 1) for k, (i, v) in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, error int")
    got = codes.compress(df.repartition(5), entries=16, rounds=3).collect()
    assert sorted((x["vec_id"], x["code"], x["error"]) for x in got) == plain(good, 4, 16, 3)
    by: dict = {}
    label = {}
    for i, _, k, *_ in rows:
        label.setdefault(i, []).append(k)
    for x in got:
        if len(label[x["vec_id"]]) == 1:
            by.setdefault(label[x["vec_id"]][0], set()).add(x["label_error"])
    assert all(len(v) == 1 for v in by.values()) and sum(v.pop() for v in by.values()) == sum(x["error"] for x in got)
    assert len({x["codebooks_sha256"] for x in got}) == 1


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert codes.compress(spark.createDataFrame([], kind)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, 1), (None, [1.0] * 4, 1)], kind)).collect() == []
    got = codes.compress(spark.createDataFrame([(4, [0.5, 0.25, -0.5, 1.0], None), (None, [0.5, 0.25, -0.5, 1.001], None)], kind)).collect()
    assert sorted(x["error"] for x in got) == [0, 1] and {x["label_error"] for x in got} == {1} and {x["code"] for x in got} == {"00000000"}
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0] * 5, 0)], kind))


def test_ids_repeated_more_often_than_entries(spark):
    rows = [(k // 50, [float(k // 50), 0.0, float(k % 50), 1.0], 0) for k in range(400)]
    books = codes.first_books(codes.sound(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), 6)
    assert books.tolist() == [[[1024 * k] for k in range(6)], [[0]] * 6, [[0]] * 6, [[1024]] * 6]
