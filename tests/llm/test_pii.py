from __future__ import annotations

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The contract's rules as written."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("a@.-_%+0123456 ()é\n"), max_size=60))
def test_base_equals_the_rules(text):
    assert pii.base_spans(text) == plain(text)


def test_base_is_linear_on_runs():
    began = time.time()
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 60_000):
        pii.base_spans(text)
    assert time.time() - began < 20


def rows():
    out = [(k, f"some words here token = \"{'%040x' % (k * 7919 ** 5)}\" and the end") for k in range(8)]
    out += [(20, "other text with token = \"ab12-zz9\" inside"), (21, "é mail a.b@c.example.com at 10.0.0.1 ok"), (22, None), (23, ""), (24, "of the 12 of the 13 of the 14 of the rest " * 3)]
    return out + [(21, "é mail a.b@c.example.com at 10.0.0.1 ok"), (None, "call +1 (415) 555-2671 now")]


def test_patterns_learned_from_seeds_find_more(spark):
    docs = spark.createDataFrame([(*r, "z") for r in rows()], "doc_id long, text string, base string")
    found = pii.find_personal_data(docs)
    got = sorted((tuple(r) for r in pii.digests(found).select("doc_id", "n_email", "n_ip", "spans").collect()), key=str)
    text = dict(rows())
    spans = {i: s for i, _, _, s in got}
    at = text[20].index("ab12-zz9")
    assert spans[20] == f"id:{at}:{at + 8}"
    assert spans[21] == "email:7:24,ip:28:36" and spans[22] == spans[23] == spans[24] == ""
    assert len(got) == len(rows()) and [r[0] for r in got].count(21) == 2
    assert spans[None] == "phone:5:22"


def test_masked(spark):
    docs = spark.createDataFrame([(*r, "z") for r in rows()], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()}
    assert got[21] == "é mail [EMAIL] at [IP] ok" and got[22] is None and got[20] == 'other text with token = "[ID]" inside'
    assert pii.masked(docs).columns == docs.columns and pii.masked(docs).count() == docs.count()


def test_nothing(empty):
    assert pii.digests(pii.find_personal_data(empty)).collect() == []
    assert pii.masked(empty.withColumn("lang", F.lit("x"))).collect() == []


def test_occurrences_stay_within_texts(spark):
    import numpy as np
    import pyarrow as pa

    from vellum.llm._words import runs, words

    (_, _, h, _), = words(pa.array(["a b"]))
    texts = pa.array(["a b c", "x a", "b c", "a b", "a b a b c", None, "a b d"])
    key = int(runs(h, 2)[0])
    table = np.zeros(64, np.uint64)
    table[key >> 58] = 1 << (key >> 52 & 63)
    total = {r["pattern"]: r["n"] for b in pii._occurrences(table)([pa.RecordBatch.from_arrays([texts], ["text"])]) for r in b.to_pylist()}
    assert {k % 2**64: n for k, n in total.items()} == {key: 4}


def test_bit_table_holds_every_pattern(spark):
    import numpy as np

    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 500)
    table = pii.bit_table(spark.createDataFrame([(int(k),) for k in keys], "pattern long"), 500)
    at = keys.view(np.uint64) >> np.uint64(64 - int(table.size).bit_length() - 5)
    assert ((table[(at >> np.uint64(6)).astype(int)] >> (at & np.uint64(63))) & np.uint64(1)).all()
    assert np.bitwise_count(table).sum() <= 500


def test_second_round_finds_what_no_seed_stands_beside(spark):
    """`token is` has seeds; `badge number` has none, but shares instances with it, and then finds one of its own."""
    own = [(k, f"the token is {k:040x} here") for k in range(1, 9)]
    own += [(20 + k, f"the token is q{k}q here") for k in range(4)] + [(30 + k, f"his badge number q{k}q here") for k in range(4)]
    own += [(40, "her badge number y9y here"), (41, "we met in room 12 today"), (42, "we met in room 13 today"), (43, "we met in room 14 today")]
    spans = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find_personal_data(spark.createDataFrame(own, "doc_id long, text string"))).collect()}
    assert spans[40] == "id:17:20" and spans[30] == "id:17:20" and spans[20] == "id:13:16"
    assert spans[41] == spans[42] == spans[43] == ""
