"""Pairs of texts whose difflib ratio reaches a threshold: an exact join by prefixes of rare character n-grams.

The ratio is 2 M / T: M characters in matching blocks, T in both texts. Two texts whose M is large share many n-grams, since a
block of k characters holds k - q + 1 of them and blocks are few:

* blocks are apart, so there are at most T - 2 M + 1;
* in a second text of SHORT characters or more difflib starts blocks at rare characters only (those that make up at most a
  hundredth of it, plus one), but for one block at the very start; so there are at most one more than it has rare characters.

Of each w n-grams in a row only the one of the least hash is taken. A block of k characters holds k - (q + w - 2) such rows of n-grams
whole, in both texts, and one n-gram is the least of w rows at most. So two texts of a pair share at least
(M - (blocks) (q + w - 2)) / w of the n-grams taken, repeated ones numbered. With the n-grams of each text in one
order, rare ones first, the first few of both must then have some in common (prefix filter), and several if a few more are
taken. FAMILIES gives q and w by how many rare characters the second text has. Texts that share enough are compared by difflib.

Rows of n-grams are many times the texts, so they are never kept: texts of a pair have lengths that differ by a seventh at most,
and one range of lengths after the other makes its rows, joins them and leaves its pairs (Index.ranges). No pair lies outside.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.functions.text import is_blank, squeeze
from vellum.session import Tables, ship

#: The least threshold at which the bound for the last family leaves every pair an n-gram.
LEAST_THRESHOLD = 0.9
SHORT = 200
#: (q, w, n-grams that a pair must share within the prefixes if it must share as many at all, most rare characters plus one of the second
#: text as a share of its length; None: bounded by T - 2 M + 1 alone). Shared passages of about 160 characters make no candidates; if pairs
#: had to share more, more common n-grams would be in the prefixes, which cost more than candidates do.
FAMILIES = ((8, 8, 32, 0.05), (7, 4, 64, 0.08), (5, 2, 96, 0.15), (3, 1, 16, None))
#: The order of n-grams comes from their counts, in SKETCH hash buckets, over about SAMPLE texts; it affects cost, not results.
#: So does the guess, which looks at the GUESS rarest n-grams of a text.
SKETCH, SAMPLE = 1 << 20, 2_000
GUESS = 64
ROWS = 1 << 17
#: A range of lengths has rows for a SHARE of all characters at once, or for LEAST_ROWS if that is more; ranges are told in STEPs of the
#: logarithm of lengths. Rows for a character of a new and an old text, about.
SHARE, LEAST_ROWS, STEP, NEW_ROWS, OLD_ROWS = 1 / 4, 1 << 24, 0.02, 1.2, 0.3
#: Characters of pairs that are compared at once, whatever their lengths.
AT_ONCE = 1 << 28
#: Spark's setting by which a query's shuffle files go when it ends, not when the JVM next collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
OLD = "gram long, key long, place int, size int, n int, family int, rare int"
NEW = "gram long, key long, place int, size int, n int"


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def least_of_rows(h: np.ndarray, w: int) -> np.ndarray:
    """The values that are the least of w in a row, each place once; all of them where there are fewer."""
    if w == 1 or len(h) < w:
        return h
    least = h[: len(h) - w + 1]
    for k in range(1, w):
        least = np.minimum(least, h[k : len(h) - w + 1 + k])
    # A value is taken if the greatest of the least values of the rows that it stands in is itself.
    most = np.zeros(len(h), np.uint64)
    for k in range(w):
        part = most[k : k + len(least)]
        np.maximum(part, least, out=part)
    return h[h == most]


def grams(codes: np.ndarray, q: int, w: int = 1) -> np.ndarray:
    """64-bit hashes of q-grams, the least of each w in a row, in no order of theirs; a repeated one is told apart by how often it has come before.

    A shorter text is one n-gram: texts so short are near only if they are equal.
    """
    if 0 < len(codes) < q:
        q = len(codes)
    n = max(len(codes) - q + 1, 0)
    with np.errstate(over="ignore"):
        h = np.full(n, q, np.uint64)
        for k in range(q):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        h = np.sort(least_of_rows(_mix(h), w))
        n = len(h)
        again = np.zeros(n, bool)
        again[1:] = h[1:] == h[:-1]
        if again.any():
            first = np.flatnonzero(~again)
            times = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
            h[again] = _mix(h[again] + times[again].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return h


def rare_characters(codes: np.ndarray) -> int:
    """How many characters of a second text can start a block."""
    n = len(codes)
    if n < SHORT:
        return n
    counts = np.unique(codes, return_counts=True)[1]
    return int(counts[counts <= n // 100 + 1].sum())


def family_of(codes: np.ndarray) -> tuple[int, int]:
    """(place in FAMILIES, number of rare characters) of a second text."""
    rare = rare_characters(codes)
    for k, (*_, share) in enumerate(FAMILIES):
        if share is None or len(codes) >= SHORT and rare + 1 <= share * len(codes):
            return k, rare
    raise AssertionError


def shared_at_least(family: int, total: int, rare: int, threshold: float, every: bool = False) -> int:
    """The least number of n-grams taken (every: of all n-grams) that two texts of `total` characters share if their ratio reaches the threshold."""
    q, w, _, share = FAMILIES[family]
    w = 1 if every else w
    m = math.ceil(threshold * total / 2 - 1e-9)
    return -(((total - 2 * m + 1 if share is None else rare + 1) * (q + w - 2) - m) // w)


def least_for_old(family: int, n: int, rare: int, threshold: float) -> int:
    """shared_at_least of a second text of n characters, whatever the first one is."""
    q, w, _, share = FAMILIES[family]
    total, lost = n + threshold / (2 - threshold) * n, q + w - 2
    if share is None:
        return math.ceil((total * (threshold / 2 * (2 * lost + 1) - lost) - lost) / w - 1e-6)
    return math.ceil((threshold * total / 2 - (rare + 1) * lost) / w - 1e-6)


def least_for_new(family: int, n: int, threshold: float) -> int:
    """shared_at_least of a first text of n characters, whatever second text of the family it meets."""
    q, w, _, share = FAMILIES[family]
    least = threshold / (2 - threshold)
    if share is None:
        return least_for_old(family, n, 0, threshold)
    return math.ceil(min(threshold * (n + m) / 2 - share * m * (q + w - 2) for m in (n * least, n / least)) / w - 1e-6)


def band(n: int, threshold: float) -> int:
    """Texts of a pair lie in one band of lengths or in bands beside each other."""
    return math.floor(math.log(max(n, 1)) / (math.log((2 - threshold) / threshold) * (1 + 1e-9)))


def prefix(h: np.ndarray, least: int, shared: int, levels: np.ndarray) -> np.ndarray:
    """The n-grams, rarest first, of which pairs that share `least` have min(shared, least) in common.

    levels: how common the n-grams of each bucket are; the level takes the place of the last byte of a hash, in front.
    """
    least = max(least, 1)
    k = max(len(h) - least + min(shared, least), 0)
    key = levels[(h >> np.uint64(44)).astype(np.int64)] << np.uint64(56) | h >> np.uint64(8)
    key = np.partition(key, k - 1)[:k] if 0 < k < len(key) else key[:k]
    key.sort()
    return key


def normal(df: DataFrame) -> DataFrame:
    """key, text, n (characters): texts in the form that is compared; blank ones are left out."""
    return df.where(~is_blank(F.col("text"))).select(F.col("key").cast("long").alias("key"), squeeze(F.col("text")).alias("text")).withColumn("n", F.length("text"))


def gram_levels(texts: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """How common n-grams are (8 times the binary logarithm of a count), by hash bucket, over about `sample` texts that a hash of the key picks."""
    n = texts.count()
    some = texts.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < (1_000_000 if n <= sample else 1_000_000 * sample // n))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(SKETCH, np.int64), [np.zeros(0, np.int64)]
        for batch in batches:
            for text in batch.column("text").to_pylist():
                codes = points(text)
                held += [(grams(codes, q, w) >> np.uint64(44)).astype(np.int64) for q, w, *_ in FAMILIES]
                if sum(map(len, held)) > ROWS or len(held) > 300:
                    total += np.bincount(np.concatenate(held), minlength=SKETCH)
                    held = []
        total += np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=SKETCH)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + ROWS]), pa.array(total[at[lo : lo + ROWS]])], names=["bucket", "n"])

    got = some.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH, np.uint64)
    out[got["bucket"].to_numpy()] = np.minimum(8 * np.log2(1 + got["n"].to_numpy()), 255).astype(np.uint64)
    return out


def _rows(batches: Iterable[pa.RecordBatch], make, names: list[str]) -> Iterator[pa.RecordBatch]:
    """make(key, text): tuples (n-grams, further values), as rows of (gram, key, place, size, n, ...)."""
    held: list[list[np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    size = 0
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for h, total, n, *more in make(text):
                for lo in range(0, len(h), ROWS):
                    part = h[lo : lo + ROWS]
                    ints = [np.full(len(part), v, np.int32) for v in (total, n, *more)]
                    held.append([part.view(np.int64), np.full(len(part), key, np.int64), np.arange(lo + 1, lo + 1 + len(part), dtype=np.int32), *ints])
                    size += len(part)
                    if size >= ROWS:
                        yield flush()
                        size = 0
    if held:
        yield flush()


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries within go at once; they would add up over the ranges otherwise."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def cut_ranges(new: dict[int, int], old: dict[int, int], most: float, reach: int) -> list[tuple[int, int]]:
    """(first, last) steps of length of new texts, ranges in order: each has rows for `most` characters or is one step.

    new, old: characters by step. Old texts reach `reach` steps to both sides. Ranges without new texts are left out."""
    out: list[tuple[int, int]] = []
    rows = lambda lo, hi: NEW_ROWS * sum(c for k, c in new.items() if lo <= k <= hi) + OLD_ROWS * sum(c for k, c in old.items() if lo - reach <= k <= hi + reach)
    for k in sorted(new):
        if out and rows(out[-1][0], k) <= most:
            out[-1] = (out[-1][0], k)
        else:
            out.append((k, k))
    return out


class Index:
    """N-gram prefixes of texts (key, text, n, as normal has them) in both roles: `new` ones are compared with `old` ones of smaller keys."""

    def __init__(self, tables: Tables, new: DataFrame, old: DataFrame | None = None, threshold: float = 0.92) -> None:
        if threshold < LEAST_THRESHOLD:
            raise ValueError(f"thresholds below {LEAST_THRESHOLD} leave short pairs without a common n-gram")
        spark = tables.spark
        ship(spark)
        self.tables = tables
        self.threshold = threshold
        self.new_text = new
        self.old_text = new if old is None else old
        self.levels = spark.sparkContext.broadcast(gram_levels(self.old_text))
        self.parts = 0

        def bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {(family_of(c)[0], band(len(c), threshold)) for batch in batches for c in map(points, batch.column("text").to_pylist())}
            yield pa.RecordBatch.from_pylist([{"family": k, "band": b} for k, b in found], pa.schema([("family", pa.int32()), ("band", pa.int32())]))

        seen = self.old_text.select("text").mapInArrow(bands, "family int, band int").distinct().collect()
        self.present = {(r["family"], r["band"] + d) for r in seen for d in (-1, 0, 1)}

    def old_rows(self, texts: DataFrame, most: int | None = None) -> DataFrame:
        """OLD rows of texts; most: the first ones of each text only."""
        threshold, sent = self.threshold, self.levels
        names = [f.split()[0] for f in OLD.split(", ")]

        def of_old(text: str):
            codes = points(text)
            family, rare = family_of(codes)
            q, w, shared, _ = FAMILIES[family]
            h = grams(codes, q, w)
            yield prefix(h, least_for_old(family, len(codes), rare, threshold), shared, sent.value)[:most], len(h), len(codes), family, rare

        return texts.select("key", "text").mapInArrow(lambda batches: _rows(batches, of_old, names), OLD)

    def new_rows(self, texts: DataFrame, most: int | None = None) -> DataFrame:
        threshold, sent, present = self.threshold, self.levels, self.present
        names = [f.split()[0] for f in NEW.split(", ")]

        def of_new(text: str):
            codes = points(text)
            n = len(codes)
            for family, (q, w, shared, _) in enumerate(FAMILIES):
                if (family, band(n, threshold)) in present:
                    h = grams(codes, q, w)
                    yield prefix(h, least_for_new(family, n, threshold), shared, sent.value)[:most], len(h), n

        return texts.select("key", "text").mapInArrow(lambda batches: _rows(batches, of_new, names), NEW)

    def ranges(self, new: DataFrame, old: DataFrame, each: int | None = None) -> list[tuple[int, int]]:
        """(least, most) steps of length of new texts, so that each range with the old texts in its reach makes few rows.

        each: the most n-grams that are taken of a text."""
        cost = F.col("n") if each is None else F.least("n", F.lit(each * len(FAMILIES)))
        by = lambda df: {r["k"]: (r["c"], r["n"]) for r in df.groupBy(self._step(F.col("n")).alias("k")).agg(F.sum(cost.cast("long")).alias("c"), F.sum(F.col("n").cast("long")).alias("n")).collect()}
        sizes = by(new), by(old)
        most = max(SHARE * max(sum(n for _, n in x.values()) for x in sizes), LEAST_ROWS)
        return cut_ranges(*({k: c for k, (c, _) in x.items()} for x in sizes), most, self._reach())

    def _step(self, n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / STEP).cast("int")

    def _reach(self) -> int:
        return math.floor(math.log((2 - self.threshold) / self.threshold) / STEP) + 2

    def _by_range(self, new: DataFrame, old: DataFrame, made: Callable[[DataFrame, DataFrame], DataFrame], schema: str | StructType, each: int | None = None) -> DataFrame:
        """The rows that made gives for new texts of each range of lengths and all old texts that may pair with them; each: as for ranges."""
        out = []
        self.parts += 1
        within = lambda df, lo, hi: df.where(F.col("n").between(math.floor(math.exp(lo * STEP)) - 1, math.ceil(math.exp((hi + 1) * STEP)) + 1) & self._step(F.col("n")).between(lo, hi))
        with shuffles_go(self.tables.spark):
            for k, (lo, hi) in enumerate(self.ranges(new, old, each)):
                own = made(within(new, lo, hi), within(old, lo - self._reach(), hi + self._reach()))
                own.write.parquet(f"{self.tables.root}/part-{self.parts}/{k}")
                out.append(f"{self.tables.root}/part-{self.parts}/{k}")
        spark = self.tables.spark
        return spark.read.schema(schema).parquet(*out) if out else spark.createDataFrame([], schema)

    def _near(self) -> tuple[Column, Column]:
        """(condition on a row of new (a) and old (b) with one n-gram, least number of such rows)."""
        total = F.col("a.n") + F.col("b.n")
        m = F.ceil(F.lit(self.threshold) * total / 2 - 1e-9)
        of = lambda value: F.element_at(F.array(*(F.lit(value(*f)) for f in FAMILIES)), F.col("b.family") + 1)
        blocks = F.when(F.col("b.family") == len(FAMILIES) - 1, total - 2 * m + 1).otherwise(F.col("b.rare") + 1)
        most = F.greatest(F.ceil((m - blocks * of(lambda q, w, *_: q + w - 2)) / of(lambda q, w, *_: w) - 1e-9), F.lit(1))
        some = F.least(most, of(lambda q, w, shared, _: shared))
        close = F.least("a.n", "b.n") + 1e-6 >= self.threshold / (2 - self.threshold) * F.greatest("a.n", "b.n")
        early = (F.col("a.place") <= F.col("a.size") - most + some) & (F.col("b.place") <= F.col("b.size") - most + some)
        return (F.col("a.key") > F.col("b.key")) & close & early, some

    def candidates(self, later: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
        """(later, earlier) that may reach the threshold; later and earlier (key) narrow either side."""
        a = self.new_text if later is None else self.new_text.join(later.select("key"), "key", "left_semi")
        b = self.old_text if earlier is None else self.old_text.join(earlier.select("key"), "key", "left_semi")
        near, some = self._near()

        def made(new: DataFrame, old: DataFrame) -> DataFrame:
            met = self.new_rows(new).alias("a").join(self.old_rows(old).alias("b"), F.col("a.gram") == F.col("b.gram")).where(near)
            met = met.select(F.col("a.key").alias("later"), F.col("b.key").alias("earlier"), some.alias("some"))
            return met.groupBy("later", "earlier").agg(F.count("*").alias("n"), F.max("some").alias("some")).where("n >= some").select("later", "earlier")

        return self._by_range(a, b, made, "later long, earlier long")

    def first_guess(self) -> DataFrame:
        """(later, earlier): for each text the one that most often has the least key of a rare n-gram's texts. At most one a text."""

        def made(new: DataFrame, old: DataFrame) -> DataFrame:
            least = self.old_rows(old, GUESS).groupBy("gram").agg(F.min_by(F.struct("key", "n"), "key").alias("first"))
            met = self.new_rows(new, GUESS).join(least, "gram").where(F.col("first.key") < F.col("key"))
            close = F.least("n", "first.n") + 1e-6 >= self.threshold / (2 - self.threshold) * F.greatest("n", "first.n")
            times = met.where(close).groupBy("key", F.col("first.key").alias("earlier")).agg(F.count("*").alias("times"))
            best = times.groupBy("key").agg(F.max_by("earlier", F.struct("times", "earlier")).alias("earlier"), F.max("times").alias("times"))
            return best.where(F.col("times") >= GUESS // 16).select(F.col("key").alias("later"), "earlier")

        return self._by_range(self.new_text, self.old_text, made, "later long, earlier long", GUESS)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The rows of pairs (later, earlier, more) whose texts reach the threshold; those of few characters in all are not cut by ranges."""

        def made(new: DataFrame, old: DataFrame) -> DataFrame:
            side = lambda df, key, text: df.select(F.col("key").alias(key), F.col("text").alias(text)).join(pairs.select(key), key, "left_semi")
            full = pairs.join(side(new, "later", "new_text"), "later").join(side(old, "earlier", "old_text"), "earlier")
            full = full.repartition(spark.sparkContext.defaultParallelism * 4)
            return full.where(ratio_at_least(self.threshold)(F.col("new_text"), F.col("old_text"))).select(*pairs.columns)

        spark = self.tables.spark
        chars = pairs.join(self.new_text.select(F.col("key").alias("later"), "n"), "later").agg(F.coalesce(F.sum(2 * F.col("n").cast("long")), F.lit(0))).first()[0]
        if chars > AT_ONCE:
            return self._by_range(self.new_text, self.old_text, made, pairs.schema)
        self.parts += 1
        with shuffles_go(spark):
            return self.tables.write(made(self.new_text, self.old_text), f"part-{self.parts}")


def may_reach(new: str, old: str, threshold: float) -> bool:
    """Whether the texts share as many n-grams as a pair must, of all of them."""
    codes = points(old)
    family, rare = family_of(codes)
    q = FAMILIES[family][0]
    least = shared_at_least(family, len(new) + len(old), rare, threshold, True)
    return least <= 0 or len(np.intersect1d(grams(points(new), q), grams(codes, q), assume_unique=True)) >= least


def reaches(new: str, old: str, threshold: float) -> bool:
    """Whether difflib's ratio reaches the threshold: its blocks, one after the other, until those still to come cannot make up for what is lost."""
    m, total = SequenceMatcher(None, new, old), len(new) + len(old)
    most, open_ = min(len(new), len(old)), [(0, len(new), 0, len(old))]
    while open_:
        if 2.0 * most / total < threshold:
            return False
        alo, ahi, blo, bhi = open_.pop()
        i, j, k = m.find_longest_match(alo, ahi, blo, bhi)
        sides = ((alo, i, blo, j), (i + k, ahi, j + k, bhi)) if k else ()
        most += k + sum(min(x[1] - x[0], x[3] - x[2]) for x in sides) - min(ahi - alo, bhi - blo)
        open_ += [x for x in sides if x[0] < x[1] and x[2] < x[3]]
    return 2.0 * most / total >= threshold


def ratio_at_least(threshold: float):
    """Pandas UDF: whether difflib's ratio of (new, kept) reaches the threshold; the argument order matters to it."""

    def verify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for new, kept in batches:
            out = []
            for a, b in zip(new, kept, strict=True):
                near = a == b
                out.append(near or may_reach(a, b, threshold) and reaches(a, b, threshold))
            yield pd.Series(out)

    return F.pandas_udf(verify, "boolean")
