"""Operators made of expressions: licences, quality, URLs."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from vellum.llm import licences, quality, urls
from vellum.llm.licence_texts import LICENCES

WORD = re.compile(r"[^ \t-\r]+")


def test_licence_variants(spark):
    mit = LICENCES["MIT"]
    texts = {
        1: mit, 2: "Copyright (c) 2020 A. Person\n\n" + mit.upper(), 3: mit.replace("\n", "  ").replace(",", " ;"), 4: mit.replace("sublicense", "sub-licence"),
        5: mit + " more", 6: None, 7: "", 8: "...", 9: "(c) 1999 X\n" + LICENCES["ISC"],
    }
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, licence_id string")
    got = {r["doc_id"]: r["licence_id"] for r in licences.scan_licences(docs, licences.known_licences(spark)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: None, 6: None, 7: None, 8: None, 9: "ISC"}


def test_licences_of_nothing(spark, empty):
    none = spark.createDataFrame([], "licence_id string, text string")
    assert licences.scan_licences(empty, licences.known_licences(spark)).collect() == []
    assert licences.scan_licences(spark.createDataFrame([(1, "MIT")], "doc_id long, text string"), none).first()["licence_id"] is None


def base(text):
    words = WORD.findall(text or "")
    n = len(words)
    wins = [tuple(words[k : k + 8]) for k in range(n - 7)]
    count = Counter(wins)
    inside = {j for k, w in enumerate(wins) if count[w] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = n < 20 or 100 * len(inside) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed


def test_quality_base(spark, documents, corpus):
    more = [(900, "a b c d e f g h\n" * 9), (901, "x " * 40), (902, "é ñ | # <>\n\n \nq\nq\n" + "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 2), (903, "\u00a0a\u2028b c")]
    docs = documents.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(i, t, 1.0) for i, t in more], "doc_id long, text string, score double"))
    labels = spark.createDataFrame([(k, 1) for k in range(10)] + [(None, 1), (3, 1), (11, 0)], "doc_id long, quality int")
    got = sorted(((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in quality.judge_quality(docs, labels).collect()), key=str)
    assert got == sorted(((i, base(t)) for i, t in [*corpus, *more]), key=str)


def test_quality_score_is_the_mean_ratio(spark):
    rows = [(1, "good words here and there"), (2, "good words again"), (3, "bad junk bad junk zz"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    hashed = {w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(quality.BUCKETS))).first()[0] for w in {w for _, t in rows for w in (t or "").split()}}
    pair = lambda a, b: spark.range(1).select(F.pmod(F.xxhash64(F.xxhash64(F.lit(a)), F.xxhash64(F.lit(b))), F.lit(quality.BUCKETS))).first()[0]
    grams = {i: [hashed[w] for w in (t or "").split()] + [pair(a, b) for a, b in zip((t or "").split(), (t or "").split()[1:])] for i, t in rows}
    raw, target = Counter(g for v in grams.values() for g in v), Counter(grams[1])
    p = lambda g: (raw[g] + 1) / (raw.total() + quality.BUCKETS)
    ratio = lambda g: math.log((target[g] + quality.PRIOR * p(g)) / (target.total() + quality.PRIOR)) - math.log(p(g))
    want = {i: sum(map(ratio, v)) / len(v) if v else 0.0 for i, v in grams.items()}
    got = {r["doc_id"]: r["score"] for r in quality.judge_quality(docs, labels).collect()}
    assert all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in want)


def test_every_trusted_document_counts(spark, monkeypatch):
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(40)] + [(0, 1), (None, 1)], "doc_id long, quality int")
    assert {r[0] for r in quality.trusted_ids(labels, 3).collect()} == {r[0] for r in quality.trusted_ids(labels).collect()} == set(range(0, 40, 2))
    docs = spark.createDataFrame([(k, f"w{k} w{k + 1}") for k in range(40)], "doc_id long, text string")
    want = quality.weights(docs, labels).first()
    monkeypatch.setattr(quality.trusted_ids, "__defaults__", (3,))
    assert quality.weights(docs, labels).first() == want and want["target_mean"] > want["raw_mean"]


def test_quality_score_ignores_case(spark):
    docs = spark.createDataFrame([(1, "good words here and there"), (2, "GOOD Words HERE and There"), (3, "bad junk")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.judge_quality(docs, labels).collect()}
    assert got[1] == got[2] != got[3]


def test_quality_of_nothing(spark, empty, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge_quality(empty, labels).collect() == []
    assert quality.judge_quality(documents, labels).where("score != 0").count() == 0
    assert quality.kept_documents(documents, labels).columns == documents.columns


def test_spellings_hold_in_any_text(spark):
    known = spark.createDataFrame([("x", "Whilst at the centre")], "licence_id string, text string")
    docs = spark.createDataFrame([(1, "while: AT the center!"), (2, "while at center")], "doc_id long, text string")
    assert {r["doc_id"]: r["licence_id"] for r in licences.scan_licences(docs, known).collect()} == {1: "x", 2: None}


def judge(url, listed, rules=urls.RULES):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(urls.UPPER, urls.LOWER)), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for r, v in rules for s, _, rest in [r.partition("/")] if (host == s or host.endswith("." + s)) and path.startswith("/" + rest)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(host == x or host.endswith("." + x) for x in listed) else "allow"


URLS = [
    None, "", "no scheme", "http://A.example.COM/en/1", "https://x.example.com/en/7", "https://x.example.com/en/70?q", "https://example.net/de/8", "https://a.example.net/de/9#t", "ftp://org/es/",
    "http://notorg/es/", "http://x.org/es", "http://spam-farm.example.org/fr/1?utm_source=a", "http://my.spam-farm.example.org", "http://spam-farm.example.org.evil.net/", "http://xspam-farm.example.org/",
    "http://spam-farm.example.org", "http://a://b/c", "http:///en/", "http://..com//en/", "http://casino-win.example.net?x#y", "https://x.example.com/" + "a/" * 3000,
]


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)] + [(3, URLS[3], "", "")], "page_id long, url string, host string, key string")
    listed = spark.createDataFrame([(u,) for u in urls.LISTED], "url string")
    got = sorted(tuple(r)[:5] for r in urls.judge_urls(pages, listed).fillna("", ["rule"]).collect())
    want = [(k, *(x if x is not None else "" for x in judge(u, urls.LISTED))) for k, u in [*enumerate(URLS), (3, URLS[3])]]
    assert got == sorted(want)


def test_listed_paths_and_queries(spark):
    listed = spark.createDataFrame([("a.com/bad",), ("www.b.net/x?id=1&utm_a=2",), (None,)], "url string")
    pages = spark.createDataFrame([(1, "http://s.a.com//bad/more"), (2, "http://a.com/badder"), (3, "http://b.net/x?utm_q=1&id=1"), (4, "http://b.net/x?id=2")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, listed, rules=()).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow"}


def test_hosts_of_one_label(spark):
    listed = spark.createDataFrame([("http://intranet/bad",), ("example",)], "url string")
    pages = spark.createDataFrame([(1, "http://intranet/bad/x"), (2, "http://intranet/good"), (3, "http://a.example"), (4, "http://example.com")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, listed, rules=()).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow"}


def test_urls_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    listed = spark.createDataFrame([], "url string")
    assert urls.judge_urls(none, listed).collect() == []
    one = spark.createDataFrame([(1, "http://q.example.fr/")], "page_id long, url string")
    assert urls.judge_urls(one, listed).first()["verdict"] == "allow"
