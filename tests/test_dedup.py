"""Near-duplicates by the prefix-filtered join against difflib on all pairs."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from vellum.operators import dedup, similarity
from vellum.session import Tables

T = dedup.THRESHOLD
WORDS = [a + b for a in ("an", "the", "ing", "er", "on", "st") for b in ("re", "ti", "ed", "or", "kz", "ly")]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def edited(r: random.Random, text: str, share: float) -> str:
    out = list(text)
    for _ in range(int(share * len(out))):
        k = r.randrange(len(out))
        out[k] = r.choice(("", out[k] + "x", r.choice("abc qz.ü"), out[k]))
    return "".join(out)


def squeeze(text: str) -> str:
    return " ".join(text.lower().split())


def in_order(new: dict[int, str | None], old: dict[int, str | None]) -> dict[int, int | None]:
    kept, out = [], {}
    for k in sorted(new):
        if new[k] and new[k].split():
            a = squeeze(new[k])
            out[k] = next((j for j in kept if old[j] and SequenceMatcher(None, a, squeeze(old[j])).ratio() >= T), None)
            kept += [k] if out[k] is None else []
    return out


def test_pairs_share_as_many_ngrams_as_the_bound_says():
    r, near = random.Random(1), 0
    for _ in range(600):
        kind = r.randrange(4)
        n = r.choice((1, 3, 8, 30, 60))
        b = prose(r, n) if kind else "".join(r.choice("ab" if r.random() < 0.5 else "abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n * 6))
        a = edited(r, b, r.choice((0.0, 0.01, 0.05, 0.08, 0.12)))
        a = a + prose(r, 1) if r.random() < 0.2 else a
        if not a or not b or SequenceMatcher(None, a, b).ratio() < T:
            continue
        near += a != b
        codes = similarity.points(b)
        family, rare = similarity.family_of(codes)
        least = similarity.shared_at_least(family, len(a) + len(b), rare, T)
        assert similarity.may_reach(a, b, T)
        assert least >= similarity.least_for_old(family, len(b), rare, T) and least >= similarity.least_for_new(family, len(a), T)
        assert a == b or least >= 1
        assert abs(similarity.band(len(a), T) - similarity.band(len(b), T)) <= 1
    assert near > 150


def test_blocks_are_bounded_by_rare_characters():
    r, checked = random.Random(2), 0
    for _ in range(200):
        b = prose(r, 80)
        a = edited(r, b, 0.06)
        blocks = [m for m in SequenceMatcher(None, a, b).get_matching_blocks() if m.size]
        assert len(blocks) <= similarity.rare_characters(similarity.points(b)) + 1
        checked += len(blocks) > 5
    assert checked > 5


def corpus(seed: int) -> dict[int, str | None]:
    r = random.Random(seed)
    texts: dict[int, str | None] = {}
    chain = prose(r, 45)
    for k in range(140):
        kind = r.randrange(6)
        if kind == 0:  # a chain: each close to the one before, not to the first
            chain = edited(r, chain, 0.05)
            texts[k] = chain
        elif kind == 1 and k > 5:  # copies and near copies of any text before
            texts[k] = edited(r, texts[r.randrange(k)] or "x", r.choice((0, 0.02, 0.05)))
        elif kind == 2 and k > 5:
            texts[k] = (texts[r.randrange(k)] or "Y").upper() + " \n"
        else:
            texts[k] = r.choice((None, "", " \t", "a", "ab cd", prose(r, r.choice((2, 6, 20, 60)))))
    return texts


def test_near_duplicates_are_those_of_the_sequential_rule(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        df = spark.createDataFrame([(k, t, "x", True) for k, t in texts.items()], "key long, text string, later string, kept boolean")
        got = dedup.near_duplicates(df).collect()
        want = in_order(texts, texts)
        assert {x["key"]: x["duplicate_of"] for x in got} == want and len(got) == len(want)
        assert all(x["kept"] == (x["duplicate_of"] is None) for x in got) and sum(not x["kept"] for x in got) > 30


def test_a_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    r = random.Random(3)
    base = " ".join(w + (chr(0x430 + k // 2) if k % 2 else "") for k, w in enumerate(prose(r, 60).split()))  # rare characters, where blocks start
    texts = {k: edited(r, base, 0.01) for k in range(120)} | {1000 + k: prose(r, 60) for k in range(20)}
    compared = []
    verified = similarity.Index.verified

    def counting(self, pairs):
        compared.append(pairs.count())
        return verified(self, pairs)

    monkeypatch.setattr(similarity.Index, "verified", counting)
    got = dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "key long, text string")).collect()
    assert {x["key"]: x["duplicate_of"] for x in got} == in_order(texts, texts)
    assert sum(not x["kept"] for x in got) > 100 and sum(compared) < 4 * len(texts)


def test_kept_texts_other_than_the_new_ones(spark):
    texts = corpus(4)
    other = {k: t if t is None else t.replace("ing", "[x]") for k, t in texts.items()}
    new, old = (spark.createDataFrame([*d.items(), (None, "nobody")], "key long, text string") for d in (texts, other))
    got = dedup.near_duplicates(new, old).collect()
    assert {x["key"]: x["duplicate_of"] for x in got} == in_order(texts, other)


def test_empty_tables_and_thresholds(spark):
    empty = spark.createDataFrame([], "key long, text string")
    assert dedup.near_duplicates(empty).collect() == [] and dedup.near_duplicate_pairs(empty).collect() == []
    one = spark.createDataFrame([(1, "a b"), (2, None)], "key long, text string")
    assert [tuple(x) for x in dedup.near_duplicates(one).collect()] == [(1, True, None)]
    with pytest.raises(ValueError):
        dedup.near_duplicates(one, threshold=0.8)


def test_ranges_of_lengths_miss_no_pair_and_keep_no_rows(spark, monkeypatch):
    """However narrow the ranges are, the outcome is the same; rows of n-grams are in no table."""
    r = random.Random(8)
    base = ["".join(r.choice("abcdefgh ijklm nopqrst uvwxyz0123456789") for _ in range(n)) for n in (60, 100, 117, 240, 300, 300, 900)]
    rows = list(enumerate([*base, *(b[: len(b) // 2] + "#" * (len(b) // 16) + b[len(b) // 2 :] for b in base), *(b[len(b) // 30 :] for b in base)]))
    df = spark.createDataFrame(rows, "key long, text string")
    written = []
    write = Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, df, name: (written.append(df.columns), write(self, df, name))[1])
    pairs = {}
    for least in (1 << 24, 1):
        monkeypatch.setattr(similarity, "LEAST_ROWS", least)
        pairs[least] = {tuple(x) for x in dedup.near_duplicate_pairs(df).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if b < a and SequenceMatcher(None, " ".join(x.split()), " ".join(y.split())).ratio() >= T}
    assert pairs[1] == pairs[1 << 24] == want and len(want) >= 14 and not any("gram" in c for c in written)
    steps = {k: 10 for k in range(200)}
    got = similarity.cut_ranges(steps, steps, 400, 10)
    assert [k for lo, hi in got for k in range(lo, hi + 1)] == list(range(200)) and len(got) > 4


def test_ratios_are_given_up_only_where_difflib_stays_below():
    r, seen = random.Random(11), set()
    for k in range(300):
        b = prose(r, r.choice((1, 5, 40, 90))) + "é" * (k % 3)
        a = r.choice(("", "z", "é", "k ")) + edited(r, b, r.choice((0.0, 0.005, 0.02, 0.06)))
        ratio = SequenceMatcher(None, a, b).ratio()
        seen.add((ratio >= T, ratio > 0.5))
        for threshold in (T, ratio, ratio + 1e-9):
            assert similarity.reaches(a, b, threshold) == (ratio >= threshold)
    assert {(True, True), (False, True), (False, False)} <= seen


def test_pairs_share_as_many_of_the_ngrams_taken_and_few_others_meet(spark):
    """Long texts: pairs share what the bounds say of the n-grams taken, which are few; texts that share a passage of 120 characters are no candidates."""
    import numpy as np

    r, families, taken = random.Random(12), set(), []
    for k in range(120):
        b = prose(r, 150) + "".join(chr(0x430 + r.randrange(30)) for _ in range((0, 20, 60, 110)[k % 4]))
        a = edited(r, b, r.choice((0.0, 0.005, 0.02)))
        if SequenceMatcher(None, a, b).ratio() < T:
            continue
        codes = similarity.points(b)
        family, rare = similarity.family_of(codes)
        q, w, *_ = similarity.FAMILIES[family]
        x, y = similarity.grams(similarity.points(a), q, w), similarity.grams(codes, q, w)
        assert len(np.intersect1d(x, y)) >= similarity.shared_at_least(family, len(a) + len(b), rare, T) >= 1
        families.add(family)
        taken.append(len(y) / len(b))
    assert len(families) >= 3 and min(taken) < 0.3
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = lambda n: " ".join("".join(r.choice(alphabet) for _ in range(5)) for _ in range(n))
    passage = words(20)
    rows = [(k, f"{words(150)} {passage} {words(150)}") for k in range(12)]
    tables = Tables(spark)
    index = similarity.Index(tables, tables.write(similarity.normal(spark.createDataFrame(rows, "key long, text string")), "texts"))
    assert index.candidates().count() == 0
