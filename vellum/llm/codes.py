"""Vector compression by product codes: exact integer k-means on each part of the vectors, by the filtering algorithm.

Vectors become integers and are cut into PARTS parts, each with a codebook of its own. In a round every partition builds a
kd-tree over each part of its vectors (block by block, so that memory is bounded). A node holds its bounding box and the
sum and count of the points under it. Codebook entries go down the tree; at a node all entries go that cannot be nearest
anywhere in the box, against the entry nearest to the box's middle. Once one is left the whole subtree is assigned
through the cached sum and count. Leaves compare their points with what is left. All sums are integers, so results don't
depend on partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._stage import Scratch, ship

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of one kd-tree; points of a leaf.
BLOCK, LEAF = 16_384, 32
#: Components from this on are no measurements: their squares summed would not fit a long.
MOST = 2**16
#: Labels up to which their sums are broadcast.
FEW_LABELS = 100_000


@dataclass
class Tree:
    """A kd-tree over points (n, d): nodes in preorder, each a range of `order`; its box, sum, count and right child (0: leaf)."""

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    total: np.ndarray
    start: np.ndarray
    end: np.ndarray
    right: np.ndarray


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree that halves each range at the median of its widest side. Sums are added up from the children."""
    order = np.arange(len(points))
    lo, hi, total, start, end, right = [], [], [], [], [], []

    def grow(a: int, b: int) -> int:
        k, own = len(start), points[order[a:b]]
        low, high = own.min(0), own.max(0)
        for column, x in ((lo, low), (hi, high), (total, None), (start, a), (end, b), (right, 0)):
            column.append(x)
        side = int(np.argmax(high - low))
        if b - a <= leaf or high[side] == low[side]:
            total[k] = own.sum(0)
        else:
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, side], middle)]
            left = grow(a, a + middle)
            right[k] = grow(a + middle, b)
            total[k] = total[left] + total[right[k]]
        return k

    if len(points):
        grow(0, len(points))
    d = points.shape[1]
    stack = lambda x: np.array(x, np.int64).reshape(-1, d)
    return Tree(order, stack(lo), stack(hi), stack(total), np.array(start, int), np.array(end, int), np.array(right, int))


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (n, k), exact integers."""
    return (points * points).sum(1)[:, None] + (entries * entries).sum(1) - 2 * _product(points, entries.T)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, exact: in doubles (fast) where no sum can pass 2**53."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.astype(float)).astype(np.int64) if bound < 2**53 else a @ b


def survivors(lo: np.ndarray, hi: np.ndarray, entries: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of `left` (ascending indexes) those entries that are nearest, ties to the lower index, to some place of the box or may be.

    Entry z goes if even at z's best corner the entry nearest to the middle is nearer, or as near and of lower index.
    """
    z = entries[left]
    best = int(np.argmin(((2 * z - lo - hi) ** 2).sum(1)))
    apart = z - z[best]
    norms = (z * z).sum(1)
    gain = norms - norms[best] - 2 * (np.where(apart > 0, hi, lo) * apart).sum(1)
    return left[(gain < 0) | ((gain == 0) & (left <= left[best]))]


def assign(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest entry of each point, sums and counts of the points by entry)."""
    code, sums, counts = np.zeros(len(points), np.int64), np.zeros_like(entries), np.zeros(len(entries), np.int64)
    todo = [(0, np.arange(len(entries)))] if len(points) else []
    while todo:
        node, left = todo.pop()
        left = survivors(tree.lo[node], tree.hi[node], entries, left) if len(left) > 1 else left
        own = tree.order[tree.start[node] : tree.end[node]]
        if len(left) == 1:
            code[own] = left[0]
            sums[left[0]] += tree.total[node]
            counts[left[0]] += len(own)
        elif tree.right[node]:
            todo += [(node + 1, left), (int(tree.right[node]), left)]
        else:
            at = left[np.argmin(squared(points[own], entries[left]), 1)]
            code[own] = at
            np.add.at(sums, at, points[own])
            counts += np.bincount(at, minlength=len(entries))
    return code, sums, counts


def integers(vectors: pa.Array) -> np.ndarray:
    """(n, d) integers of a list array without nulls, all of one length."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(vectors), -1)


def blocks(batches: Iterable[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.Table]:
    """Whole batches put together to tables of about `size` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            held.append(batch.slice(lo, size))
            if sum(b.num_rows for b in held) >= size:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles) of rows whose vector is not null and whose components are all numbers below MOST in size."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < MOST))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(F.col("embedding").isNotNull() & whole)
    return rows.withColumn("embedding", F.col("embedding").cast("array<double>"))


def nearest_codes(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of each row, against codebooks (part, entry, position)."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_parts, _, d = sent.value.shape
        for table in blocks(batches):
            x = integers(table["embedding"])
            codes, error = np.zeros((len(x), n_parts), np.int64), np.zeros(len(x), np.int64)
            for p, entries in enumerate(sent.value):
                own = np.ascontiguousarray(x[:, p * d : (p + 1) * d])
                codes[:, p] = assign(build(own), own, entries)[0]
                error += ((own - entries[codes[:, p]]) ** 2).sum(1)
            text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            out = pa.table({"vec_id": table["vec_id"], "label": table["label"], "code": pa.array(text, pa.string()), "error": pa.array(error)})
            yield from out.to_batches()

    return rows.mapInArrow(encoded, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def moved_sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, n and total (array) of the points nearest to each entry, added up over all rows."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(books)
    d = books.shape[2]

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_parts, n_entries, d = sent.value.shape
        sums, counts = np.zeros((n_parts, n_entries, d), np.int64), np.zeros((n_parts, n_entries), np.int64)
        for table in blocks(batches):
            x = integers(table["embedding"])
            for p, entries in enumerate(sent.value):
                own = np.ascontiguousarray(x[:, p * d : (p + 1) * d])
                _, s, n = assign(build(own), own, entries)
                sums[p] += s
                counts[p] += n
        part, entry = np.nonzero(counts)
        columns = {"part": pa.array(part), "entry": pa.array(entry), "n": pa.array(counts[part, entry])}
        columns |= {f"s{k}": pa.array(sums[part, entry, k]) for k in range(d)}
        yield from pa.table(columns).to_batches()

    names = ", ".join(f"s{k} long" for k in range(d))
    found = rows.select("embedding").mapInArrow(summed, f"part long, entry long, n long, {names}")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(d)))


def first_books(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """The parts of the vectors of the least different vec_ids, ascending; of several vectors of one id the least.

    One top-k scan where ids don't repeat; each further scan starts behind the ids that are found.
    """
    ids: list[int] = []
    found: list[np.ndarray] = []
    while len(ids) < entries:
        more = rows.where("vec_id is not null" if not ids else F.col("vec_id") > ids[-1]).select("vec_id", "embedding")
        got = more.orderBy("vec_id", "embedding").limit(entries - len(ids)).toArrow()
        if not got.num_rows:
            break
        seen, at = np.unique(got["vec_id"].to_numpy(), return_index=True)
        ids += seen.tolist()
        found.append(integers(got["embedding"])[at])
    x = np.concatenate(found)
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(rows: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after `rounds` of Lloyd's algorithm over all rows; to the driver come sums and counts of the entries only."""
    for _ in range(rounds):
        got = moved_sums(rows, books).toArrow()
        books = books.copy()
        if got.num_rows:
            sums = np.stack([got[f"s{k}"].to_numpy() for k in range(books.shape[2])], 1)
            books[got["part"].to_numpy(), got["entry"].to_numpy()] = sums // got["n"].to_numpy()[:, None]
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each sound row of vectors (vec_id, embedding, label).

    A null vector, or one with a null, not finite or huge (from MOST on in size) component, is dropped. So is one whose length
    is not that of the vector of the least vec_id; that length must be a multiple of parts, else ValueError. An empty vector
    counts as no vector. Repeated rows are encoded each; null vec_ids are encoded but start no codebook. With fewer ids
    than entries codebooks are as much smaller; without any vector with an id the result is empty.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = sound(vectors).where(F.size("embedding") > 0)
    first = rows.where("vec_id is not null").orderBy("vec_id", "embedding").select(F.size("embedding")).first()
    length = first[0] if first else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("embedding") == length)
    books = train(rows, first_books(rows, entries, parts), rounds) if length else np.zeros((parts, 0, 0), np.int64)
    if not length:
        rows = rows.limit(0)
    tables = Scratch(spark)
    coded = tables.write(nearest_codes(rows, books), "codes")
    totals = tables.write(coded.groupBy(F.col("label").alias("same_label")).agg(F.sum("error").alias("label_error")), "labels")
    totals = F.broadcast(totals) if totals.limit(FEW_LABELS + 1).count() <= FEW_LABELS else totals
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("same_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
