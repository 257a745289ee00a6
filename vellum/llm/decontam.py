"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of lower-cased words. The CGK walk of a sequence emits the current word at each step and moves on
when a random bit of (repetition, step, word) says so; sequences at a small edit distance emit mostly the same at the same
steps. CLASSES holds, by the number of an item's words, how many steps a walk has and how many of them are sampled: no more steps
than the shortest item of the class has words, so that a walk from its first word stays inside. A text is walked from every
word, an item from each word from which the walk stays inside it. Each of REPETITIONS repetitions samples other steps under
other bits; walks that agree at all samples collide. At the most edits (MAX_EDITS of the words, at random places) one repetition finds an
item with probability 0.83 or more at every length, as measured, so that five miss about one in 10,000 at most. Items of
fewer than five words may have no edit, and equal walks always collide. Each collision is verified: the word edit distance
of the item to the best substring of the text around the place must be at most MAX_EDITS of the item's words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._stage import Scratch, matched, ship
from vellum.llm._words import Members, mix, words
from vellum.session import spread

REPETITIONS = 5
#: (least words of an item, steps, samples); an item belongs to the last class that it reaches.
CLASSES = ((1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 4, 3), (5, 5, 2), (8, 8, 4), (12, 8, 5), (16, 10, 6), (20, 12, 6), (30, 16, 8))
PAD = max(steps for _, steps, _ in CLASSES)
MAX_EDITS = 0.2
#: Items of at most so many words have their collisions sifted before they are verified one by one.
SIFTED = 64
#: Items in one scan; more are taken in blocks of as many, one scan each.
BLOCK = 20_000
HITS = "doc_id long, text_hash long, item_id long, start_word long, edits long, item_words long"
U64 = np.uint64


def picks(kind: int, repetition: int) -> tuple[int, ...]:
    """The steps that a repetition samples in a class."""
    _, steps, samples = CLASSES[kind]
    order = np.argsort(mix(np.arange(steps, dtype=U64) + U64(1000 * repetition + 7)))
    return tuple(sorted(order[:samples].tolist()))


def class_of(n: int) -> int:
    return max(k for k, (least, _, _) in enumerate(CLASSES) if n >= least)


def walk_keys(h: np.ndarray, starts: np.ndarray, repetition: int, kinds: Iterable[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each class: (LSH key, words passed at the last sampled step) of the walks from `starts`.

    Classes share a walk and differ in what they sample. Past the end of h every word is 0.
    """
    wanted = {kind: picks(kind, repetition) for kind in kinds}
    h = np.concatenate([h, np.zeros(PAD, U64)])
    bits = mix(h ^ U64(0x1234567 + repetition)).astype(np.uint32)
    at = starts.astype(np.int32)
    keys = {kind: np.full(len(starts), repetition + 1 + 100 * kind, U64) for kind in wanted}
    passed: dict[int, np.ndarray] = {}
    last = max((p[-1] for p in wanted.values()), default=-1)
    with np.errstate(over="ignore"):
        for step in range(last + 1):
            said = None
            for kind, own in wanted.items():
                if step in own:
                    said = h[at] if said is None else said
                    key = (keys[kind] ^ said) * U64(0x9E3779B97F4A7C15)
                    keys[kind] = key ^ key >> U64(29)
                if step == own[-1]:
                    passed[kind] = at - starts
            if step < last:
                at += (bits[at] >> np.uint32(step) & np.uint32(1)).astype(np.int32)
    return {kind: (mix(keys[kind]), passed[kind]) for kind in wanted}


def edit_distance_within(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """(edits, start in text) of the substring of text nearest to the item by word edit distance, if at most `most`.

    Ties: the substring that ends first. Rows are the item's words; a text may begin and end anywhere.
    """
    n = len(text)
    cost = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    steps = np.arange(n + 1)
    for k, word in enumerate(item):
        swap = cost[:-1] + (text != word)
        new = np.empty(n + 1, np.int64)
        new[0] = k + 1
        new[1:] = np.minimum(swap, cost[1:] + 1)
        came = np.empty(n + 1, np.int64)
        came[0] = 0
        came[1:] = np.where(swap <= cost[1:] + 1, begin[:-1], begin[1:])
        # Insertions run along the row: the least of new[j'] + (j - j').
        shifted = new - steps
        low = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == low, steps, 0))
        cost, begin = low + steps, came[source]
        if cost.min() > most:
            return None
    j = int(np.argmin(cost))
    return (int(cost[j]), int(begin[j])) if cost[j] <= most else None


class Index:
    """LSH keys of the items' windows, by class and repetition."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids, self.words = [], []
        texts = pa.array([t for _, t in items], pa.string())
        for lo, hi, h, first in words(texts):
            for k in range(lo, hi):
                own = h[first[k - lo] : first[k - lo + 1]]
                if len(own):
                    self.ids.append(items[k][0])
                    self.words.append(own.copy())
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.kinds = sorted({class_of(int(n)) for n in self.sizes})
        held: dict[tuple[int, int], list] = {}
        for k, own in enumerate(self.words):
            kind, starts = class_of(len(own)), np.arange(len(own))
            for r in range(REPETITIONS):
                key, passed = walk_keys(own, starts, r, (kind,))[kind]
                fits = starts + passed < len(own)
                held.setdefault((r, kind), []).append((key[fits], np.full(int(fits.sum()), k), starts[fits]))
        self.tables = {}
        for place, rows in held.items():
            key, owner, offset = (np.concatenate(c) for c in zip(*rows, strict=True))
            order = np.argsort(key, kind="stable")
            self.tables[place] = (Members(key, 20), key[order], owner[order], offset[order])
        short = np.zeros((len(self.words), SIFTED), U64)
        for k, own in enumerate(self.words):
            if len(own) <= SIFTED:
                short[k, : len(own)] = own
        self.short = short

    def collisions(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """(item, place of its first word in h, row), once each, of the windows that share a key and pass the sieve; row is that of each word.

        A place may be a few words off, and lies before the text's first word where the window shows no item's beginning.
        """
        found = [np.zeros((0, 3), np.int64)]
        starts = np.arange(len(h))
        for r in range(REPETITIONS):
            for kind, (key, _) in walk_keys(h, starts, r, self.kinds).items():
                members, keys, owner, offset = self.tables[r, kind]
                at, _ = members.find(key)
                lo = np.searchsorted(keys, key[at], "left")
                times = np.searchsorted(keys, key[at], "right") - lo
                which = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
                start = np.repeat(at, times)
                found.append(np.stack([owner[which], start - offset[which], row[start]], 1))
        every = np.concatenate(found)
        order = np.lexsort((every[:, 2], every[:, 1], every[:, 0]))
        every = every[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]).any(1)
        every = every[new]
        short = self.sizes[every[:, 0]] <= SIFTED if len(every) else np.zeros(0, bool)
        return np.concatenate([every[~short], self.sifted(h, every[short])])

    def sifted(self, h: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Those collisions of short items around whose place enough of the item's words stand near where they should.

        An occurrence within the edits has them within twice the edits of there: no collision with one goes.
        """
        most = int(MAX_EDITS * SIFTED)
        pad = SIFTED + 2 * most
        around = np.concatenate([np.zeros(pad, U64), h, np.zeros(pad, U64)])
        keep = []
        for lo in range(0, len(found), 1 << 12):
            part = found[lo : lo + (1 << 12)]
            n = self.sizes[part[:, 0]]
            edits = (MAX_EDITS * n).astype(np.int64)
            own, near = self.short[part[:, 0]], np.zeros((len(part), SIFTED), bool)
            place = np.clip(part[:, 1], -pad + 2 * most, len(h))
            widest = 2 * int(edits.max())
            for shift in range(-widest, widest + 1):
                near |= (abs(shift) <= 2 * edits)[:, None] & (around[(place + pad + shift)[:, None] + np.arange(SIFTED)] == own)
            near &= np.arange(SIFTED) < n[:, None]
            keep.append(part[near.sum(1) >= n - edits])
        return np.concatenate(keep) if keep else found

    def verify(self, h: np.ndarray, found: set[tuple[int, int]]) -> dict[int, tuple[int, int]]:
        """Of one text's words: item -> (edits, first word), the best of its verified collisions (then the first)."""
        best: dict[int, tuple[int, int]] = {}
        done: set[tuple[int, int, int]] = set()
        for item, place in sorted(found):
            own = self.words[item]
            most = int(MAX_EDITS * len(own))
            lo, hi = max(0, place - most), min(len(h), place + len(own) + most)
            if (item, lo, hi) in done or (item in best and best[item][0] == 0):
                continue
            done.add((item, lo, hi))
            part = h[lo:hi]
            if np.isin(own, part).sum() < len(own) - most:
                continue
            if (near := edit_distance_within(own, part, most)) and (item not in best or (near[0], lo + near[1]) < best[item]):
                best[item] = (near[0], lo + near[1])
        return best


def _search(index: Index, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in HITS.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        ids, marks = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
        for lo, _, h, first in words(batch.column("text")):
            if not len(h):
                continue
            gaps = np.diff(first)
            owner = np.repeat(np.arange(len(gaps)), gaps)
            by_row: dict[int, set] = {}
            for item, at, row in index.collisions(h, owner).tolist():
                by_row.setdefault(row, set()).add((item, at - int(first[row])))
            for row, found in by_row.items():
                own = h[first[row] : first[row + 1]]
                for item, (edits, start) in sorted(index.verify(own, found).items()):
                    rows.append((ids[lo + row], marks[lo + row], index.ids[item], start, edits, len(index.words[item])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, edits, item_words: one row for each document row and benchmark item found in it, with the best place and its edits.

    documents (doc_id, text) and benchmark (item_id, text); other columns are not read. Null, empty and blank texts
    hold nothing; such items are found nowhere. Repeated document rows give repeated hits;
    repeated items too. The items are a query set: taken in blocks of BLOCK, each against all documents in one scan.
    """
    return _hits(documents, benchmark).drop("text_hash")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that hold no benchmark item. Rows are known by doc_id and a hash of the text."""
    return matched(documents, _hits(documents, benchmark), "left_anti")


def _hits(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """HITS of leaks; text_hash tells unlike texts with one doc_id apart."""
    spark = documents.sparkSession
    ship(spark)
    items = benchmark.where("text is not null").select("item_id", "text")
    blocks = max(1, -(-items.count() // BLOCK))
    tables = Scratch(spark)
    texts = spread(documents.select("doc_id", "text")).withColumn("text_hash", F.xxhash64("text"))
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow().to_pylist()
        index = spark.sparkContext.broadcast(Index(sorted(((x["item_id"], x["text"]) for x in block), key=lambda x: (x[0] is None, x[0] or 0, x[1]))))
        found = texts.mapInArrow(lambda batches, index=index: _search(index.value, batches), HITS)
        if blocks > 1:  # one block's index at a time
            found = tables.write(found, f"block-{k}")
            index.destroy()
        out = found if out is None else out.unionByName(found)
    return out
