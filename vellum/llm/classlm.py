"""Brown class-based n-gram model: exchange clustering, class transitions and word emissions, smoothed.

Words are known by 64-bit hashes. One pass counts every word of the training documents. Every one of them gets a class:

1. The SEEDS most frequent words are clustered on the driver, from a matrix of fixed size, by exchange: a word at a time
   moves to the class that raises the likelihood of the class bigrams most.
2. Rounds of distributed exchange (Uszkoreit and Brants, 2008) then move all other words, however many: a pass over the
   training texts counts each word's classes before and after it, and Spark brings a word's counts together and gives it
   the class of the greatest likelihood under the class bigrams of the pass.

Texts are split into words twice, to count words and to store each text as places in the head; all later passes read these.

The HEAD most frequent words (a bounded table of hash, count and class) go to all tasks. Words outside meet their class and
count in a hash join by word, in training and in scoring, whether they are predicted or are what a word is predicted from: the head
saves work and changes no context (the words outside are one symbol of the driver's matrix). Only the word after one that
training has never seen is predicted without context, by the class's share of all tokens. P(text) is the product of
P(class | class before) and P(word | class); a word that training has never seen has the probability that one token more
than all tokens and words would have.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._stage import Scratch, checkpointed
from vellum.llm._words import Members, signed, tally, words

#: Words in the table that all tasks hold (at most 26 bytes each), words that the driver clusters, and classes.
HEAD, SEEDS, CLASSES = 1 << 19, 1500, 48
#: Rounds of exchange on the driver and, for all other words, in Spark.
EXCHANGE_ROUNDS, SPARK_ROUNDS = 8, 2
#: Weight of the class bigram against the class unigram.
BIGRAM_WEIGHT = 0.95
#: Distinct words that a task holds before it passes partial counts on, contexts likewise, and tokens of a step (workers' memory).
PARTIAL_WORDS, PARTIAL_CONTEXTS, CHUNK_TOKENS = 1 << 20, 1 << 20, 1 << 17
U64 = np.uint64
#: Stands for the end of a text, which is a token; no word has this hash (words are hashed with their length).
END = U64(0x0E4D0E4D0E4D0E4D)


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 7, is 2; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def with_ends(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with END after each text, and the index of each text's first token (one more at the end)."""
    n = len(first) - 1
    return np.insert(h, first[1:], END), first + np.arange(n + 1)


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = (with_ends(h, first)[0] for batch in batches for _, _, h, first in words(batch.column("text")))
    for h, c in tally(parts, PARTIAL_WORDS):
        yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(c)], names=["h", "c"])


@dataclass
class Head:
    """Sorted hashes of the most frequent words with counts and symbols (a clustered word's rank, or its band's number)."""

    members: Members
    counts: np.ndarray
    symbols: np.ndarray
    n_symbols: int

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash in the head; outside, the place after the last."""
        uniq, back = np.unique(h, return_inverse=True)
        at, rank = self.members.find(uniq)
        place = np.full(len(uniq), len(self.counts), np.int64)
        place[at] = rank
        return place[back]


def make_head(h: np.ndarray, c: np.ndarray, clustered: int) -> Head:
    """From hashes and counts of the head words. END is always the first symbol."""
    order = np.lexsort((h, -c, h != END))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    band = np.log2(np.maximum(c, 1)).astype(np.int64)
    k = min(clustered, len(h))
    bands = np.unique(band[rank >= k])[::-1]
    symbols = np.where(rank < k, rank, k + np.searchsorted(-bands, -band))
    by_hash = np.argsort(h)
    return Head(Members(h), c[by_hash], symbols[by_hash].astype(np.int64), k + len(bands) + 1)


TOKENS = "doc_id long, place array<int>, tail array<long>"


def _place(head):
    """Each text as the places of its tokens in the head (the end is the last token), and the hashes of those outside in order."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in TOKENS.split(", ")]
        outside = len(head.value.counts)
        for batch in batches:
            for lo, hi, h, first in words(batch.column("text")):
                tokens, at = with_ends(h, first)
                place = head.value.places(tokens)
                out = np.flatnonzero(place == outside)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)) for offsets, values in ((at, place.astype(np.int32)), (np.searchsorted(out, at), signed(tokens[out])))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), *lists], names=names)

    return of


def _stored(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, places, index of each text's first token (one more at the end), hashes of tokens outside the head), chunk by chunk."""
    for batch in batches:
        lists, tails = batch.column("place"), batch.column("tail")
        offs, tail_offs = lists.offsets.to_numpy(), tails.offsets.to_numpy()
        values, hashes = lists.values.to_numpy(), tails.values.to_numpy().view(U64)
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_TOKENS, "right")) - 1)
            yield batch.column("doc_id").slice(lo, hi - lo), values[offs[lo] : offs[hi]].astype(np.int64), offs[lo : hi + 1].astype(np.int64) - offs[lo], hashes[tail_offs[lo] : tail_offs[hi]]
            lo = hi


def _count_bigrams(head) -> object:
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = head.value.n_symbols
        symbols = np.append(head.value.symbols, n - 1)
        total = np.zeros(n * n, np.int64)
        for _, place, at, _ in _stored(batches):
            symbol = symbols[place]
            before = np.roll(symbol, 1)
            before[at[:-1]] = 0  # a text follows an end
            total += np.bincount(before * n + symbol, minlength=n * n)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["pair", "c"])

    return of


def exchange(bigrams: np.ndarray, clustered: int, classes: int, rounds: int = EXCHANGE_ROUNDS) -> np.ndarray:
    """The class of each symbol. Symbol 0 (END) and those from `clustered` on have classes of their own.

    bigrams: counts by symbol and next symbol. Words start in round robin by rank; a round visits them in order and moves
    each to the class that makes sum f(class bigrams) - sum f(class totals) largest, f(x) = x log x. Ties: lowest class.
    """
    n = len(bigrams)
    k = max(1, min(classes, clustered - 1))
    cls = np.empty(n, np.int64)
    cls[0] = 0
    cls[1:clustered] = 1 + np.arange(clustered - 1) % k
    cls[clustered:] = 1 + k + np.arange(n - clustered)
    size = 1 + k + n - clustered
    hot = np.zeros((n, size))
    hot[np.arange(n), cls] = 1
    m = bigrams.astype(float)
    to, fro = m @ hot, (hot.T @ m).T  # by word: counts into each class after it, and from each class before it
    g = hot.T @ to
    f = lambda x: x * np.log(np.maximum(x, 1))
    for _ in range(rounds):
        moved = 0
        for w in range(1, clustered):
            a = int(cls[w])
            own, t, s = m[w, w], to[w].copy(), fro[w].copy()
            t[a] -= own
            s[a] -= own
            # Without w:
            g[a] -= t
            g[:, a] -= s
            g[a, a] -= own
            out, into = g.sum(1), g.sum(0)
            rest = slice(1, 1 + k)
            gain = (f(g[rest] + t) - f(g[rest])).sum(1) + (f(g[:, rest] + s[:, None]) - f(g[:, rest])).sum(0)
            diag = np.arange(1, 1 + k)
            d = g[diag, diag]
            gain += f(d + t[diag] + s[diag] + own) + f(d) - f(d + t[diag]) - f(d + s[diag])
            n_out, n_in = t.sum() + own, s.sum() + own
            gain -= f(out[rest] + n_out) - f(out[rest]) + f(into[rest] + n_in) - f(into[rest])
            b = 1 + int(np.argmax(gain)) if gain.max() > gain[a - 1] + 1e-9 else a
            g[b] += t
            g[:, b] += s
            g[b, b] += own
            if b != a:
                moved += 1
                cls[w] = b
                to[:, a] -= m[:, w]
                to[:, b] += m[:, w]
                fro[:, a] -= m[w]
                fro[:, b] += m[w]
        if not moved:
            break
    return cls


def _classed(batches: Iterable[pa.RecordBatch], known: np.ndarray) -> Iterator[tuple]:
    """(doc_id, index of each text's first token, place in the head, hashes outside, class, class before) of all tokens, chunk by chunk.

    A text follows an end (class 0). known: class by place in the head, and that of words outside."""
    for doc_id, place, at, tail in _stored(batches):
        cls = known[place].astype(np.int64)
        before = np.roll(cls, 1)
        before[at[:-1]] = 0
        yield doc_id, at, place, tail, cls, before


def _hashes(head: Head, place: np.ndarray, tail: np.ndarray) -> np.ndarray:
    h = np.append(head.members.keys, U64(0))[place]
    h[place == len(head.counts)] = tail
    return h


def _contexts(head, known, size: int, seeds: int):
    """Of each word that is no seed, the classes on both sides (h, x, c): x is before * (size + 1) + after. A pair may come again.

    Class `size` is that of words without one yet, and of those outside the head."""
    side = size + 1

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = head.value
        outside = len(model.counts)
        free = np.append(model.symbols >= seeds, False)
        out = lambda h, x, c: pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(x, pa.int32()), pa.array(c)], names=["h", "x", "c"])

        def summed(held: list) -> pa.RecordBatch:
            key, c = np.unique(np.concatenate(held), return_counts=True)
            return out(model.members.keys[key // side**2], key % side**2, c)

        held: list = []
        size_held = 0
        for _, _, place, tail, cls, before in _classed(batches, known.value):
            x = before * side + np.roll(cls, -1)
            own = free[place]
            held.append(place[own] * side**2 + x[own])
            size_held += len(held[-1])
            if size_held > PARTIAL_CONTEXTS:
                yield summed(held)
                held, size_held = [], 0
            if len(tail):
                yield out(tail, x[place == outside], np.ones(len(tail), np.int64))
        if held:
            yield summed(held)

    return of


PAIRS = "lh long, rh long, lx int, rx int, l_free boolean, r_free boolean"


def _pairs(head, known, size: int, seeds: int):
    """Words beside each other of which one is outside the head: hashes, classes (`size` outside), whether they are no seeds."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = np.append(head.value.symbols >= seeds, True)
        for _, _, place, tail, cls, before in _classed(batches, known.value):
            tokens = _hashes(head.value, place, tail)
            at = np.flatnonzero((cls == size) | (before == size))
            # Before a text's first token stands the end, as before the array's first.
            cols = [signed(tokens[at - 1]), signed(tokens[at]), before[at].astype(np.int32), cls[at].astype(np.int32), free[place[at - 1]], free[place[at]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[f.split()[0] for f in PAIRS.split(", ")])

    return of


def _resolved(pairs: DataFrame, classes: DataFrame, size: int, how: str = "inner") -> DataFrame:
    """pairs with lc and rc, the classes of both words, and count, that of a right word outside the head, from classes (h, cls, c).

    Each side is joined only where it is outside the head: such words are rare, so that no key is frequent."""
    left, right = classes.select(F.col("h").alias("lh"), F.col("cls").alias("lc")), classes.select(F.col("h").alias("rh"), F.col("cls").alias("rc"), F.col("c").alias("count"))
    none = F.lit(None).cast("long")
    l_out, r_out = F.col("lx") == size, F.col("rx") == size
    parts = [
        pairs.where(l_out & ~r_out).join(left, "lh", how).withColumns({"rc": F.col("rx"), "count": none}),
        pairs.where(~l_out & r_out).join(right, "rh", how).withColumn("lc", F.col("lx")),
        pairs.where(l_out & r_out).join(left, "lh", how).join(right, "rh", how),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _bigrams(known, size: int, inside: bool):
    """Bigrams of classes (x: before * (size + 1) + class, c); inside: of words that both have a class."""
    side = size + 1

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((side, side), np.int64)
        for *_, cls, before in _classed(batches, known.value):
            total += np.bincount(before * side + cls, minlength=side * side).reshape(side, side)
        if inside:
            total[size] = total[:, size] = 0
        x = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(total.ravel()[x])], names=["x", "c"])

    return of


def log_transitions(g: np.ndarray) -> np.ndarray:
    """Natural log of P(class | class before), smoothed; the last row is that of no context. g: counts, a row more than columns."""
    size = g.shape[1]
    into = g.sum(0)
    one = (into + 1) / (into.sum() + size)
    out = g.sum(1, keepdims=True)
    two = np.where(out > 0, g / np.maximum(out, 1), one)
    two[-1] = one
    return np.log(BIGRAM_WEIGHT * two + (1 - BIGRAM_WEIGHT) * one)


def _assign(g: np.ndarray, told: bool):
    """The best class of each word under class bigrams g (h, cls, c) from its contexts (h, x, c), which come in order of h.

    x from squares on: the class of one neighbour outside the head, before (then after, a side later). told: whether these
    are there; if not, no class is known of such neighbours."""
    size = g.shape[1]
    side = size + 1
    log_p, log_n = log_transitions(g), np.log(np.maximum(g.sum(0), 1))

    def best(h: np.ndarray, x: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        new = np.append(True, h[1:] != h[:-1])
        row, n = np.cumsum(new) - 1, int(new.sum())
        table = lambda k, row, c: np.bincount(row * side + k, c, n * side).reshape(n, side)
        both = x < side**2
        before, after = table(x[both] // side, row[both], c[both]), table(x[both] % side, row[both], c[both])
        times = before.sum(1, keepdims=True)
        if told:
            before[:, size] = 0
            row, c = row[~both], c[~both]
            after_it, cls = np.divmod(x[~both] - side**2, side)
            for k, counts in enumerate((before, after)):
                counts += table(cls[after_it == k], row[after_it == k], c[after_it == k])
        gain = before @ log_p + after[:, :size] @ log_p[:size].T - times * log_n
        cls = 1 + np.argmax(gain[:, 1:], 1)  # class 0 is the end's alone
        return pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(cls, pa.int32()), pa.array(times[:, 0].astype(np.int64))], names=["h", "cls", "c"])

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column("h").to_numpy(), batch.column("x").to_numpy().astype(np.int64), batch.column("c").to_numpy().astype(float)]
            # The last word may go on in the next batch.
            last = int(np.searchsorted(part[0], part[0][-1]))
            if last or held and held[-1][0][0] != part[0][0]:
                held.append([v[:last] for v in part])
                yield best(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            held.append([v[last:] for v in part])
        if held:
            yield best(*map(np.concatenate, zip(*held, strict=True)))

    return of


SCORES = "rid long, doc_id long, n_tokens long, n_known long, base_log double, score double, tail array<struct<lh:long,rh:long,lx:int,rx:int,n:long>>"


def _score(head, known, cells) -> object:
    """cells: by class before and class, log10 of the transition less that of the class's tokens."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40
        names = [f.split()[0] for f in SCORES.split(", ")]
        model, size = head.value, cells.shape[1]
        table = np.append(cells, np.zeros((len(cells), 1)), 1)  # words outside the head, and those after them, are scored by join
        table[size] = 0
        count = np.append(model.counts, 0)
        log_count, log_more = np.log10(np.maximum(count, 1)), np.log10(count + 1.0)
        for doc_id, at, place, outside, c, before in _classed(batches, known.value):
            tokens = _hashes(model, place, outside)
            n = len(doc_id)
            row = np.repeat(np.arange(n), np.diff(at))
            by = lambda x, row=row, n=n: np.bincount(row, x, n)
            # Words outside the head and those after them, once for each text and word before, with their number there.
            out = np.flatnonzero((c == size) | (before == size))
            lh, rh = np.where(before[out] == size, tokens[out - 1], U64(0)), np.where(c[out] == size, tokens[out], U64(0))
            keys = [row[out], lh, rh, before[out], c[out]]
            order = np.lexsort(keys[::-1])
            keys = [k[order] for k in keys]
            new = np.ones(len(order), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], 0)
            at_new = np.flatnonzero(new)
            times = np.diff(np.append(at_new, len(order)))
            offsets = np.searchsorted(keys[0][at_new], np.arange(n + 1))
            lh, rh, lx, rx = (k[at_new] for k in keys[1:])
            tail = pa.StructArray.from_arrays([pa.array(signed(lh)), pa.array(signed(rh)), pa.array(lx, pa.int32()), pa.array(rx, pa.int32()), pa.array(times)], names=["lh", "rh", "lx", "rx", "n"])
            sums = [by(x) for x in ((c != size).astype(float), log_more[place], table[before, c] + log_count[place])]
            cols = [pa.array(np.arange(rid, rid + n)), doc_id, pa.array(np.diff(at)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tail)]
            rid += n
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return of


def vocabulary(training: DataFrame) -> DataFrame:
    """(h, c): every token of the training texts (column text), with its count."""
    return training.select("text").mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def head_cut(counts: DataFrame, most: int) -> int:
    """The least power of two so that at most `most` words are at least as frequent."""
    by = {r["b"]: r["n"] for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
    cut, held = max(by, default=0) + 1, 0
    while cut > 0 and held + by.get(cut - 1, 0) <= most:
        cut -= 1
        held += by.get(cut, 0)
    return 1 << cut


def _matrix(rows: pa.Table, size: int) -> np.ndarray:
    """Counts by class before (the last: none known) and class, from rows (x, c) of class bigrams."""
    g = np.zeros((size + 1) ** 2)
    np.add.at(g, rows.column("x").to_numpy(), rows.column("c").to_numpy())
    return g.reshape(size + 1, size + 1)[:, :size]


def score_documents(documents: DataFrame, most: int = HEAD, clustered: int = SEEDS, classes: int = CLASSES, rounds: int = SPARK_ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of documents (doc_id, text).

    Learns from rows that are not held out. Null and empty texts are the end alone. Without training rows every token is
    unseen. Repeated rows stay and count as often; other columns are not read. most: words of the head; clustered: those
    of them that the driver clusters; rounds: of exchange for all others, at least one.
    """
    spark = documents.sparkSession
    own = documents.select("doc_id", "text")
    training = own.where(~held_out(F.col("doc_id"))).select("text")
    with Scratch(spark) as scratch:
        counts = scratch.write(vocabulary(training), "counts")
        n = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
        cut = head_cut(counts, most)
        got = counts.where(F.col("c") >= cut).toArrow()
        h, c = got.column("h").to_numpy().view(U64), got.column("c").to_numpy()
        if n["tokens"] and END not in h:  # the end is always in the head
            ends = counts.where(F.col("h") == int(signed(np.array([END]))[0])).first()["c"]
            h, c = np.append(h, END), np.append(c, ends)
        head = make_head(h, c, clustered)
        shared = spark.sparkContext.broadcast(head)
        tokens = scratch.write(own.mapInArrow(_place(shared), TOKENS), "tokens")
        training = tokens.where(~held_out(F.col("doc_id")))
        pairs = training.mapInArrow(_count_bigrams(shared), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
        bigrams = np.zeros(head.n_symbols**2)
        bigrams[pairs.column("pair").to_numpy()] = pairs.column("c").to_numpy()
        seeds = max(1, min(clustered, len(h)))
        cls = exchange(bigrams.reshape(head.n_symbols, head.n_symbols), seeds, classes)[:seeds]
        size = 1 + max(1, min(classes, seeds - 1))
        known = np.full(len(h) + 1, size, np.int16)
        is_seed = np.flatnonzero(head.symbols < seeds)
        known[is_seed] = cls[head.symbols[is_seed]]
        side = size + 1
        for k in range(rounds):
            sent = spark.sparkContext.broadcast(known)
            own_sums = training.mapInArrow(_bigrams(sent, size, k > 0), "x int, c long")
            found = training.mapInArrow(_contexts(shared, sent, size, seeds), "h long, x int, c long")
            if k:  # Words outside the head have a class since the first round.
                pairs = training.mapInArrow(_pairs(shared, sent, size, seeds), PAIRS)
                pairs = scratch.write(_resolved(scratch.write(pairs, f"pairs-{k}"), assigned.where(F.col("c") < cut), size), f"resolved-{k}")
                scratch.drop(f"pairs-{k}")
                own_sums = own_sums.unionByName(pairs.select((F.col("lc") * side + F.col("rc")).alias("x"), F.lit(1).cast("long").alias("c")))
                more = lambda h, free, at, out, cls: pairs.where(F.col(free) & (F.col(out) == size)).select(F.col(h).alias("h"), (side * side + at * side + F.col(cls)).cast("int").alias("x"), F.lit(1).cast("long").alias("c"))
                found = found.unionByName(more("rh", "r_free", 0, "lx", "lc")).unionByName(more("lh", "l_free", 1, "rx", "rc"))
            g = _matrix(own_sums.groupBy("x").agg(F.sum("c").alias("c")).toArrow(), size)
            found = found.repartition("h").sortWithinPartitions("h")
            assigned = scratch.write(found.mapInArrow(_assign(g, k > 0), "h long, cls int, c long"), f"assigned-{k}")
            scratch.drop(f"resolved-{k}")
            got = assigned.where(F.col("c") >= cut).toArrow()
            known = known.copy()
            at, rank = head.members.find(got.column("h").to_numpy().view(U64))
            known[rank] = got.column("cls").to_numpy()[at]
        told = spark.sparkContext.broadcast(known)
        tail_words = assigned.where(F.col("c") < cut)
        inside = training.mapInArrow(_bigrams(told, size, True), "x int, c long")
        pairs = _resolved(scratch.write(training.mapInArrow(_pairs(shared, told, size, seeds), PAIRS), "pairs"), tail_words, size)
        outside = pairs.select((F.col("lc") * side + F.col("rc")).alias("x"), F.lit(1).cast("long").alias("c"))
        g = _matrix(inside.unionByName(outside).groupBy("x").agg(F.sum("c").alias("c")).toArrow(), size)
        scratch.drop("pairs")
        each = float(np.log10(float(n["tokens"] + n["words"] + 1)))
        # Unseen words have 1 / (tokens + words + 1) in all; the others share the rest.
        cells = (log_transitions(g) - np.log(np.maximum(g.sum(0), 1)) + np.log1p(-1 / (n["tokens"] + n["words"] + 2))) / np.log(10)
        rows = scratch.write(tokens.mapInArrow(_score(shared, told, cells), SCORES), "rows")
        tail = rows.select("rid", F.explode("tail").alias("t")).select("rid", "t.*")
        # A word that training has never seen has no class: what follows it has no context.
        tail = _resolved(tail, tail_words, size, "left").select("rid", "n", F.coalesce("lc", F.lit(size)).alias("before"), F.col("rc").alias("cls"), "count", (F.col("rx") == size).alias("out"))
        # (size + 1) * size rows.
        cell = spark.createDataFrame([(p, a, float(cells[p, a])) for p in range(size + 1) for a in range(size)], "before int, cls int, cell double")
        tail = tail.join(F.broadcast(cell), ["before", "cls"], "left")
        seen = F.col("count").isNotNull()
        logs = tail.groupBy(F.col("rid").alias("tail_id")).agg(
            F.sum(F.when(seen, F.col("n") * F.log10(F.col("count") + 1)).otherwise(0.0)).alias("more"),
            F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("seen"),
            F.sum(F.col("n") * F.when(~F.col("out"), F.col("cell")).when(seen, F.col("cell") + F.log10("count")).otherwise(-each)).alias("scored"),
        )
        out = rows.drop("tail").join(logs, F.col("rid") == F.col("tail_id"), "left")
        none = lambda name: F.coalesce(name, F.lit(0))
        return checkpointed(
            out.select(
                "doc_id",
                held_out(F.col("doc_id")).alias("held_out"),
                "n_tokens",
                (F.col("n_known") + none("seen")).alias("n_known"),
                F.lit(n["tokens"]).cast("long").alias("train_tokens"),
                (F.col("base_log") + none("more") - F.col("n_tokens") * each).alias("base_score"),
                (F.col("score") + none("scored")).alias("score"),
            )
        )
