"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon has a fixed part and a part learned from labelled rows: words and word beginnings that toxic rows hold far
more often. Features are lexicon densities, lexicon words near the second person, capitals, punctuation and obfuscation
rates and length. The trees (logistic loss, exact splits over quantile bins) and the calibration are fitted on the driver
from a bounded sample of labelled rows; scoring runs in Arrow batches over all rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._stage import ship

#: The most labelled rows, and characters of theirs, that are fitted on; more are thinned by a hash of doc_id.
FIT_ROWS, FIT_CHARS = 12_000, 64_000_000
#: The most learned lexicon entries.
LEXICON_SIZE = 4_000
PREFIX = 5
CUT = 0.3
#: Words that are insults wherever they stand. Fixed values.
INSULTS = frozenset(("idiot", "idiots", "moron", "morons", "stupid", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "scum", "loser", "losers", "dumb", "ugly", "imbecile", "vermin", "filth", "freak", "coward", "liar", "hate", "jerk", "fool", "fools"))
#: The second person in the corpus's languages. Fixed values.
SECOND_PERSON = frozenset(("you", "your", "yours", "you're", "u", "ur", "tu", "te", "toi", "ton", "ta", "vous", "votre", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "usted", "ti", "vosotros"))
#: Signs that stand for letters in disguised words. Fixed values.
LEET = str.maketrans("013457@$!", "oieastasi")
NAMES = ("fixed_rate", "fixed_any", "learned_rate", "learned_best", "learned_any", "prefix_rate", "near_person", "capitals", "shouted", "punctuation", "exclaims", "obfuscated", "disguised_hits", "log_words")
_WORD = re.compile(r"[^ \t-\r]+")
_EDGE = ".,;:!?\"'()[]{}<>#$%&*|-_"
NEAR = 5


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4, is 2; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Lexicon:
    """Log odds of words and of word beginnings (of PREFIX letters)."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)


def tokens(text: str) -> list[str]:
    return [w.strip(_EDGE) for w in _WORD.findall(text.lower())]


def beside(hits: list[int], persons: list[int]) -> int:
    """How many of the places in hits have one of persons within NEAR words; both ascend."""
    if not persons:
        return 0
    at, to = np.array(hits), np.array(persons)
    first = np.searchsorted(to, at - NEAR)
    return int((to[np.minimum(first, len(to) - 1)] <= at + NEAR)[first < len(to)].sum())


def features(text: str, lexicon: Lexicon) -> list[float]:
    raw = _WORD.findall(text)
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    chars = len(text)
    low = [w.strip(_EDGE) for w in text.lower().split()] if n else []
    fixed = [k for k, w in enumerate(low) if w in INSULTS]
    learned = [lexicon.words[w] for w in low if w in lexicon.words]
    starts = [lexicon.prefixes[p] for w in low if len(w) > PREFIX and (p := w[:PREFIX]) in lexicon.prefixes]
    hits = fixed if fixed else [k for k, w in enumerate(low) if w in lexicon.words] if learned else []
    near = beside(hits, [k for k, w in enumerate(low) if w in SECOND_PERSON]) if hits else 0
    odd = [w for w in raw if not w.isalpha() and (c := w.strip(_EDGE)) and not c.isalpha() and not c.isdigit() and c.isascii()]
    unmasked = [w.lower().translate(LEET).replace("*", "").replace(".", "").strip(_EDGE) for w in odd]
    disguised = sum(w in INSULTS for w in unmasked)
    shouted = sum(1 for w in raw if len(w) > 2 and w.isupper())
    return [
        len(fixed) / n,
        min(len(fixed), 5),
        sum(learned) / n,
        max(learned, default=0.0),
        min(len(learned), 20),
        sum(starts) / n,
        near / n,
        sum(map(str.isupper, text)) / chars,
        shouted / n,
        sum(text.count(c) for c in "!?#$%&*") / chars,
        text.count("!") / n,
        len(odd) / n,
        min(disguised, 5),
        math.log1p(n),
    ]


def learn_lexicon(rows: list[tuple[str, int]]) -> Lexicon:
    """Entries whose share of toxic rows is far above their share of others: log odds with add-half smoothing and a z test."""
    n = [sum(1 for _, y in rows if not y), sum(y for _, y in rows)]
    out = Lexicon()
    for target, cut in ((out.words, None), (out.prefixes, PREFIX)):
        seen = (Counter(), Counter())
        for text, y in rows:
            ws = {w for w in tokens(text) if w}
            seen[y].update({w[:cut] for w in ws if len(w) > cut} if cut else ws)
        scored = []
        for w, a in seen[1].items():
            b = seen[0][w]
            odds = math.log((a + 0.5) / (n[1] - a + 0.5)) - math.log((b + 0.5) / (n[0] - b + 0.5))
            z = odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if z > 2.6 and odds > 1 and a >= 3:
                scored.append((-z, w, odds))
        target.update({w: odds for _, w, odds in sorted(scored)[:LEXICON_SIZE]})
    return out


@dataclass
class Trees:
    """Boosted regression trees of a fixed depth, stored level by level."""

    start: float
    features: np.ndarray  # trees x inner nodes
    cuts: np.ndarray
    leaves: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows, depth = np.arange(len(x)), int(math.log2(self.leaves.shape[1]))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    start = math.log(prior / (1 - prior))
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    edges = [np.unique(np.concatenate([e, np.quantile(pos, np.linspace(0, 1, 9)) if len(pos := col[col > 0]) else []])) for e, col in zip(edges, x.T, strict=True)]
    size = max(len(e) for e in edges) + 1
    binned = np.stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T, strict=True)])
    m, inner = x.shape[1], 2**depth - 1
    fs, cs, ls = (np.zeros((rounds, k), t) for k, t in ((inner, np.int64), (inner, float), (inner + 1, float)))
    margin = np.full(len(y), start)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local = at - first
            gs, hs = (np.stack([np.bincount(local * size + b, w, n * size) for b in binned]).reshape(m, n, size).cumsum(2) for w in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[:, :, -1] = 0
            for node in range(n):
                f, b = np.unravel_index(int(np.argmax(gain[:, node])), (m, size))
                fs[r, first + node] = f
                cs[r, first + node] = edges[f][b] if b < len(edges[f]) else np.inf
            node = at
            at = 2 * at + 1 + (x[np.arange(len(y)), fs[r, node]] > cs[r, node])
        leaf = at - inner
        ls[r] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += ls[r][leaf]
    return Trees(start, fs, cs, ls)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit (pool adjacent violators); between knots it is linear."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, sum of margins
    for s, t in zip(margin[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    xs = np.array([b[2] / b[1] for b in blocks])
    ys = np.array([(b[0] + 0.01) / (b[1] + 0.1) for b in blocks])
    return xs, np.maximum.accumulate(ys)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: Iterable[str]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts], float).reshape(-1, len(NAMES))
        margin = self.trees.margin(x)
        # A last hundredth keeps the order of the margins within flat parts of the calibration.
        return np.clip(0.99 * np.interp(margin, *self.knots) + 0.01 / (1 + np.exp(-margin)), 0, 1)


def fit(rows: list[tuple[int, str, int]]) -> Model:
    """The model from (doc_id, text, toxic). Without both labels every score is the share of toxic rows.

    By a hash of doc_id, two fifths of the rows make the learned lexicon, two fifths the trees and one the calibration,
    so that no part sees how another fits its own rows.
    """
    if len({y for _, _, y in rows}) < 2:
        share = float(rows[0][2]) if rows else 0.0
        empty = Trees(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
        return Model(Lexicon(), empty, (np.zeros(1), np.array([share])))
    part = np.array([zlib.crc32(f"part-{i}".encode()) % 5 for i, _, _ in rows])
    y = np.array([t for _, _, t in rows], float)
    pick = lambda *ks: np.flatnonzero(np.isin(part, ks)) if len(rows) >= 200 else np.arange(len(rows))
    lexicon = learn_lexicon([(rows[k][1], rows[k][2]) for k in pick(0, 1)])
    x = np.array([features(t, lexicon) for _, t, _ in rows])
    trees = boost(x[(at := pick(2, 3))], y[at])
    at = pick(4)
    return Model(lexicon, trees, isotonic(trees.margin(x[at]), y[at]))


def training_rows(documents: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> list[tuple[int, str, int]]:
    """(doc_id, text, toxic) of labelled rows that are not held out, in order; about `most` at most, thinned by a hash, and
    further until their texts have FIT_CHARS characters at most.

    Of several labels for one doc_id the largest counts. Null ids and labels are left out.
    """
    own = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = own.count()
    share = 1_000_000 if n <= most else 1_000_000 * most // n
    chosen = lambda c: F.pmod(F.xxhash64(c), F.lit(1_000_000)) < share
    found = documents.select("doc_id", "text").where(chosen(F.col("doc_id")))
    found = found.join(F.broadcast(own.where(chosen(F.col("label_id")))), F.col("doc_id") == F.col("label_id"))
    mixed, part = F.pmod(F.xxhash64("doc_id", F.lit("thin")), F.lit(1_000_000)), 1_000_000
    while part and (found.where(mixed < part).agg(F.sum(F.length("text"))).first()[0] or 0) > FIT_CHARS:
        part = part * 3 // 4
    got = found.where(mixed < part).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic").toArrow()
    return sorted(zip(*(got.column(k).to_pylist() for k in range(3)), strict=True)) if got.num_rows else []


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents (doc_id, text; others are not read).

    Nothing but the text enters a score; null counts as empty. Repeated rows stay.
    """
    spark = documents.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fit(training_rows(documents, labels)))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                score = model.value.score(t or "" for t in part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(score)], names=["doc_id", "score"])

    out = documents.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
