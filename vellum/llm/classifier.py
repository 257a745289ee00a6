"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

The n-grams of a text are its words and pairs of words; shapes of words (letters by case, digits and marks, runs drawn
together) and pairs of shapes; and echoes, n-grams known only by how far back their last word was said last (up to ECHO
words). Each falls into one of BUCKETS by a hash; a bucket's value is 1 + log of its count, and a text's values have length
1. FTRL-proximal keeps, for every bucket, a sum of gradients and of their squares, from which the weight follows; small
weights are exactly 0. A score is the logistic function of one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import _words
from vellum.llm._stage import Scratch, ship
from vellum.session import spread

BUCKETS = 1 << 18
ECHO = 8
#: The most labelled rows, and the most values of theirs, that the model is fitted on; more are thinned by a hash of doc_id.
FIT_ROWS, FIT_VALUES = 12_000, 12_000_000
CUT = 0.7
#: Passes over the labelled rows: as many as make UPDATES updates, within bounds, so that a small table is fitted as well.
UPDATES, LEAST_PASSES, MOST_PASSES = 40_000, 4, 50
#: Learning rate and its offset; penalties on the size and the square of weights.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 1
_SHAPE[97:123] = 2
_SHAPE[128:] = 2
_SHAPE[48:58] = 3
_KINDS = _words.mix(np.arange(8, dtype=np.uint64) + np.uint64(0xF7))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word's shape: classes of its bytes, each run of one class once."""
    kind = _SHAPE[raw]
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    keep = np.cumsum(inside[:-1]) > 0
    same = np.zeros(len(raw), bool)
    same[1:] = kind[1:] == kind[:-1]
    same[starts] = False
    keep &= ~same
    place = np.concatenate(([0], np.cumsum(keep)))
    return _words.hashes(kind[keep], place[starts], place[ends])


def _rows_of(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of n entries: where each starts, and the row that holds it whole."""
    sizes = np.diff(first)
    row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - n + 1, 0))
    at = np.concatenate([np.arange(a, max(a, b - n + 1)) for a, b in zip(first[:-1], first[1:], strict=True)]) if len(sizes) else np.zeros(0, int)
    return at.astype(int), row


def echoes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, row) of each word that its row has said at most ECHO words before, by the least distance."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = np.zeros(len(h), np.int64)
    for d in range(ECHO, 0, -1):
        same = np.flatnonzero((h[d:] == h[:-d]) & (row[d:] == row[:-d])) + d
        last[same] = d
    at = np.flatnonzero(last)
    return last[at], row[at]


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row offsets, buckets, values) chunk by chunk, over the rows of texts in order; a null counts as empty."""
    for lo, hi, raw, offs in _words.chunks(texts):
        starts, ends, first = _words.spans(raw, offs)
        said, shape = _words.hashes(raw, starts, ends), shapes(raw, starts, ends)
        (ones, one_rows), (twos, two_rows) = _rows_of(first, 1), _rows_of(first, 2)
        far, far_rows = echoes(said, first)
        with np.errstate(over="ignore"):
            grams = [said[ones] + _KINDS[0], shape[ones] + _KINDS[1], _words.runs(said, 2)[twos] + _KINDS[2], _words.runs(shape, 2)[twos] + _KINDS[3], far.astype(np.uint64) + _KINDS[4]]
        bucket = (_words.mix(np.concatenate(grams)) % np.uint64(BUCKETS)).astype(np.int64)
        key, count = np.unique(np.concatenate([one_rows, one_rows, two_rows, two_rows, far_rows]) * BUCKETS + bucket, return_counts=True)
        row, value = key // BUCKETS, 1 + np.log(count)
        offsets = np.searchsorted(row, np.arange(hi - lo + 1))
        value /= np.sqrt(np.bincount(row, value * value, hi - lo))[row]
        yield offsets, key % BUCKETS, value


@dataclass
class Model:
    """Weights by bucket (0: none) and the bias."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = 0.0

    def score(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for offsets, bucket, value in features(texts):
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            out.append(logistic(np.bincount(row, self.weights[bucket] * value, len(offsets) - 1) + self.bias))
        return np.concatenate(out)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], updates: int = UPDATES) -> Model:
    """FTRL-proximal over (buckets, values, label) in the order given, pass after pass. One bucket more is the bias, unpenalised by L1.

    With no rows or one label only, every score is near the share of label 1, by add-half smoothing.
    """
    good = sum(y for _, _, y in examples)
    prior = float(np.log((good + 0.5) / (len(examples) - good + 0.5)))
    if good in (0, len(examples)):
        return Model(bias=prior)
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        free = np.where(at == BUCKETS, 0, L1)
        return np.where(np.abs(z[at]) <= free, 0.0, -(z[at] - np.sign(z[at]) * free) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(min(max(-(-updates // len(examples)), LEAST_PASSES), MOST_PASSES)):
        for buckets, values, y in examples:
            at, value = np.append(buckets, BUCKETS), np.append(values, 1.0)
            w = weight(at)
            g = (logistic(w @ value + prior) - y) * value
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / ALPHA * w
            n[at] = new
    every = weight(np.arange(BUCKETS + 1))
    return Model(every[:BUCKETS], prior + float(every[BUCKETS]))


def labelled(documents: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, buckets, values, quality of labelled rows that are not held out, about `most` at most.

    Of several labels for one doc_id the least counts. Null ids and labels are left out.
    """
    own = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").cast("int").alias("quality"))
    n = own.count()
    share = 1_000_000 if n <= most else 1_000_000 * most // n
    chosen = lambda c: F.pmod(F.xxhash64(c), F.lit(1_000_000)) < share
    found = documents.select("doc_id", "text").where(chosen(F.col("doc_id")))
    found = found.join(F.broadcast(own.where(chosen(F.col("label_id")))), F.col("doc_id") == F.col("label_id"))

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for offsets, bucket, value in features(batch.column("text")):
                rows = batch.slice(lo, len(offsets) - 1)
                lo += len(rows)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *lists, rows.column("quality")], names=["doc_id", "buckets", "values", "quality"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "text", "quality").mapInArrow(featured, f"doc_id {kind}, buckets array<int>, values array<float>, quality int")


def train(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, values: int = FIT_VALUES) -> Model:
    """The model of the labelled documents; those beyond the bounds are thinned by a hash, whole documents at a time."""
    with Scratch(documents.sparkSession) as tables:
        found = tables.write(labelled(documents, labels, rows), "features")
        mixed = F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(1_000_000))
        share = 1_000_000
        while share and (found.where(mixed < share).agg(F.sum(F.size("buckets"))).first()[0] or 0) > values:
            share = share * 3 // 4
        got = found.where(mixed < share).select(mixed.alias("place"), "doc_id", "buckets", "values", "quality").toArrow()
    keys = sorted(zip(got["place"].to_pylist(), got["doc_id"].to_pylist(), (len(b) for b in got["buckets"]), range(got.num_rows), strict=True))
    take = lambda name, k: got[name][k].values.to_numpy()  # noqa: E731  a view, not a copy
    return fit([(take("buckets", k), take("values", k), got["quality"][k].as_py()) for *_, k in keys])


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents (doc_id, text; others are not read).

    labels: doc_id, quality (0 or 1). Nothing but the text enters a score; null counts as empty, and a text without words
    scores by the bias alone. Repeated rows stay and score alike. Rows with a null doc_id are scored, not held out.
    """
    spark = documents.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(documents, labels))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(model.value.score(batch.column("text")))], names=["doc_id", "score"])

    out = spread(documents.select("doc_id", "text")).mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
