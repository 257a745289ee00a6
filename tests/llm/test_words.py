from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm._words import Members, runs, words

WORD = re.compile(r"[^ \t-\r]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbBéÉ \n\t\u00a0\u2028.x"), max_size=30)), max_size=12)


def hashes(texts, size):
    out = []
    for _, _, h, first in words(pa.array(texts, pa.string()), size):
        out += [h[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    return out


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_the_maximal_runs_and_hash_by_text(texts):
    told = [[w.translate(str.maketrans("AB", "ab")) for w in WORD.findall(t or "")] for t in texts]
    got = hashes(texts, 16)
    assert [len(x) for x in got] == [len(x) for x in told]
    to = {}
    for ws, hs in zip(told, got):
        for w, h in zip(ws, hs):
            assert to.setdefault(w, h) == h
    assert len(set(to.values())) == len(to)
    assert got == hashes(texts, 1 << 20)


def test_slices_and_empty_arrays():
    arr = pa.array(["a b", "c", None, "a"]).slice(1)
    assert [len(x) for x in hashes(arr.to_pylist(), 4)] == [1, 0, 1]
    assert hashes([], 4) == []
    assert len(runs(np.zeros(3, np.uint64), 5)) == 0


def test_members():
    m = Members(np.array([5, 9, 2**63], np.uint64), 4)
    at, rank = m.find(np.array([1, 9, 5, 2**63, 2**64 - 1], np.uint64))
    assert at.tolist() == [1, 2, 3] and m.keys[rank].tolist() == [9, 5, 2**63]
