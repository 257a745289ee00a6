"""Near-duplicates by one-permutation hashing, optimal densification, banded buckets and stars.

1. Every text becomes its set of 5-word shingles (64-bit hashes). Rows with one set form a class, which is one node.
2. One hash per shingle fills BINS bins (bin: high bits, value: the rest, least kept). An empty bin borrows from bins that
   a fixed random probe sequence names, until it meets a full one (optimal densification).
3. ROWS bins make a band key, and nodes that share a key share a bucket. A bucket yields two stars, around its least and
   its greatest node: edges in proportion to its members, whatever its size.
4. An edge becomes a link when the full sets pass 100 * intersection >= 75 * union. Members of a bucket that are in no
   component with a centre yet meet again without the centres, until a round finds no new link.
5. Buckets that still hold members of several components yield every other pair across components, less those that the
   sizes, the distances to the centres (a metric) or parities of the sets rule out; all three are true bounds. So each two nodes that share a bucket are in one component
   or are known not to be similar.
6. Links are joined into components by least-label propagation with pointer jumping.

A pair with similarity 0.75 shares no bucket with probability (1 - 0.75**5)**45, 5 in a million.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._stage import Scratch, checkpointed, matched
from vellum.llm._words import mix, runs, signed, words

SHINGLE, PERCENT = 5, 75
ROWS, BANDS = 5, 45
BINS = ROWS * BANDS
U64 = np.uint64
#: log2 of the bits of the table that says whose sets are needed.
NEED_BITS = 22
#: Members of a bucket that meet the others' components in one group.
CHUNK = 256
#: 64-bit words of a set's parity bits. Two sets differ in at least as many shingles as parity bits.
PARITIES = 16
#: The most links that one task joins into components.
FEW_LINKS = 1 << 18
SETS = "rid long, doc_id long, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>"
#: Probe sequence of each bin: row k holds every bin's k-th choice.
_PROBES = (mix(np.arange(64 * BINS, dtype=U64) + U64(0xD1CE)) % U64(BINS)).astype(np.int64).reshape(64, BINS)


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes; the whole sequence when it is shorter than a shingle."""
    return np.unique(runs(h, min(SHINGLE, len(h)) or 1) + U64(min(SHINGLE, len(h))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """BINS densified bin values of a set that is not empty."""
    h = mix(shingles)
    bins = ((h >> U64(32)) * U64(BINS) >> U64(32)).astype(np.int64)
    order = np.lexsort((h, bins))
    bins, h = bins[order], h[order]
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, U64)
    full = np.zeros(BINS, bool)
    full[bins[first]] = True
    out[bins[first]] = h[first]
    empty = np.flatnonzero(~full)
    own = out.copy()
    for probe in _PROBES:
        if not len(empty):
            break
        hit = full[probe[empty]]
        out[empty[hit]] = own[probe[empty[hit]]]
        empty = empty[~hit]
    if len(empty):  # 64 misses: all take the least shingle
        out[empty] = h.min()
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key a band; the band's number is part of it."""
    parts = sig.reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = mix(np.arange(BANDS, dtype=U64))
        for k in range(ROWS):
            key = mix(key ^ parts[:, k])
    return key


def parities(shingles: np.ndarray) -> np.ndarray:
    """Of each of 64 * PARITIES groups that a hash makes, whether the set holds an odd number."""
    group = (mix(shingles) % U64(64 * PARITIES)).astype(np.int64)
    odd = (np.bincount(group, minlength=64 * PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        n = U64(len(shingles))
        a = mix(np.array([mix(shingles).sum(dtype=U64) + n], U64))
        b = mix(np.array([mix(shingles ^ U64(0xABCDEF)).sum(dtype=U64) ^ n], U64))
    return int(signed(a)[0]), int(signed(b)[0])


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the batch, its shingle set)."""
    for lo, hi, h, first in words(batch.column("text")):
        for row in range(lo, hi):
            own = h[first[row - lo] : first[row - lo + 1]]
            yield row, shingle_set(own) if len(own) else own


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    rid = TaskContext.get().partitionId() << 40
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            n, s1, s2, keys, lens = [], [], [], [], []
            for _, shingles in _sets(part):
                n.append(len(shingles))
                a, b = _digest(shingles) if len(shingles) else (None, None)
                s1.append(a)
                s2.append(b)
                lens.append(BANDS if len(shingles) else 0)
                if len(shingles):
                    keys.append(signed(band_keys(signature(shingles))))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), flat)
            ids = pa.array(np.arange(rid, rid + part.num_rows))
            rid += part.num_rows
            yield pa.RecordBatch.from_arrays([ids, part.column("doc_id").cast(pa.int64()), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), bands], names=[f.split()[0] for f in SETS.split(", ")])


def _needed(bits: np.ndarray):
    """Of batches (text), the sets whose digest hits the table: s1, s2, shingles, odd (their parities)."""
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                s1, s2, flat, lens, odd = [], [], [], [0], []
                for _, shingles in _sets(batch.slice(lo, 512)):
                    if not len(shingles):
                        continue
                    a, b = _digest(shingles)
                    at = (a & (2**64 - 1)) >> (64 - NEED_BITS)
                    if bits[at >> 6] >> U64(at & 63) & U64(1):
                        s1.append(a)
                        s2.append(b)
                        flat.append(signed(shingles))
                        odd.append(parities(shingles))
                        lens.append(lens[-1] + len(shingles))
                if s1:
                    sets = pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(np.concatenate(flat)))
                    odds = pa.ListArray.from_arrays(pa.array(range(0, PARITIES * len(odd) + 1, PARITIES), pa.int32()), pa.array(np.concatenate(odd)))
                    yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), sets, odds], names=["s1", "s2", "shingles", "odd"])

    return of


def _centred(members: DataFrame) -> DataFrame:
    """(key, node, lo, hi): members of buckets of two or more, with the bucket's least and greatest node."""
    centres = members.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    return members.join(centres, "key").select("key", "node", "lo", "hi")


def _stars(centred: DataFrame) -> DataFrame:
    """Distinct edges (a, b), a < b, between each bucket's centres and its other nodes."""
    ends = F.array(F.struct(F.col("lo").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("hi").alias("b")))
    return centred.select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a < b").distinct()


def _apart(centred: DataFrame, roots: DataFrame, done: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct edges (a, b), a < b, between members of a bucket in different components that may pass and are not in done.

    centred: the buckets of the first round, whose members done compares with both centres. Every such pair has an end
    outside the bucket's largest component, so these ends meet all members, which are dealt out in chunks.
    """
    own = centred.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = own.groupBy("key", "root").agg(F.count("*").alias("n"))
    parts = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("members"), F.count("*").alias("parts")).where("parts > 1")
    mixed = own.join(parts.select("key", F.col("top.root").alias("top"), F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks")), "key").join(sizes, "node")
    for end in ("lo", "hi"):
        near = done.select(F.col("a" if end == "lo" else "b").alias(end), F.col("b" if end == "lo" else "a").alias("node"), F.col("ratio").alias(f"{end}_ratio"))
        mixed = mixed.join(near, [end, "node"], "left").withColumn(f"{end}_ratio", F.coalesce(f"{end}_ratio", F.lit(1.0)))
    mixed = scratch.write(mixed.select("key", "node", "root", "top", "chunks", "size", "odd", "lo_ratio", "hi_ratio"), "mixed")
    left = mixed.where("root != top").select("key", *(F.col(c).alias(f"x_{c}") for c in ("node", "root", "top", "size", "odd", "lo_ratio", "hi_ratio")), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    right = mixed.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).drop("chunks", "top")
    apart = (F.col("root") != F.col("x_root")) & ((F.col("root") == F.col("x_top")) | (F.col("x_node") < F.col("node")))
    apart &= 100 * F.least("size", "x_size") >= PERCENT * F.greatest("size", "x_size")
    for end in ("lo", "hi"):
        apart &= F.abs(F.col(f"{end}_ratio") - F.col(f"x_{end}_ratio")) <= 1 - PERCENT / 100 + 1e-9
    unlike = sum((F.bit_count(F.col("odd")[k].bitwiseXOR(F.col("x_odd")[k])) for k in range(PARITIES)), F.lit(0))
    both = F.col("size") + F.col("x_size")
    apart &= (100 + PERCENT) * (both - unlike) >= 2 * PERCENT * both
    pairs = left.join(right, ["key", "chunk"]).where(apart)
    pairs = pairs.select(F.least("node", "x_node").alias("a"), F.greatest("node", "x_node").alias("b")).distinct()
    return pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")


def _verify(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """edges (a, b) with ratio and linked, by the full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    near = edges.join(right, "b").join(left, "a")
    same = F.size(F.array_intersect("sa", "sb"))
    near = near.select("a", "b", same.alias("same"), (F.size("sa") + F.size("sb")).alias("both"))
    union = F.col("both") - F.col("same")
    return near.select("a", "b", (F.col("same") / union).alias("ratio"), (100 * F.col("same") >= PERCENT * union).alias("linked"))


def _union(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links of one task, by union-find with the least node as root."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the least node reachable.

    Up to `few` links (a bound, checked by counting) are joined by union-find in one task on an executor. More stay
    distributed: each round a node takes the least label of itself and its neighbours, then its label's label; rounds are
    logarithmic in the diameter, and tables are checkpointed, so lineage stays short. Both ways give the same rows.
    """
    links = checkpointed(links.select("a", "b"))
    if links.limit(few + 1).count() <= few:
        return links.coalesce(1).mapInArrow(_union, "node long, root long")
    both = checkpointed(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(seen, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        now = checkpointed(step.join(jump, "root", "left").select("node", "old", F.coalesce(F.least("root", "next"), "root").alias("root")))
        if not now.where("root < old").limit(1).count():
            return now.select("node", "root")
        labels = now.select("node", "root")


def _judged(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and stays: whether a row is its component's least by doc_id (nulls last),
    then text_hash. Rows with an empty set all stay."""
    own = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    with Scratch(documents.sparkSession) as scratch:
        rows = scratch.write(own.mapInArrow(_sketch, SETS), "rows")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
        kinds = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("rid").alias("node"), least, F.first("bands").alias("bands"))
        kinds = scratch.write(kinds, "kinds")
        centred = scratch.write(_centred(kinds.select("node", F.explode("bands").alias("key"))), "centred")
        roots = checkpointed(components(_links(own, kinds.select("node", "s1", "s2"), centred, scratch)))
        keyed = checkpointed(rows.select("rid", "doc_id", "text_hash", "n_shingles", "s1", "s2"))
        kinds = kinds.join(roots, "node", "left").select("s1", "s2", "least", F.coalesce("root", "node").alias("root"))
        # Only components of several classes need their least row looked up.
        firsts = kinds.join(roots.select("root").distinct(), "root").groupBy("root").agg(F.min("least").alias("first"))
        kinds = kinds.join(firsts, "root", "left")
        kinds = checkpointed(kinds.select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), F.coalesce("first", "least").alias("first"), F.lit(True).alias("grouped")))
    out = keyed.join(kinds, (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2")), "left")
    stays = F.col("grouped").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("grouped"), F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), stays.alias("stays"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of documents (doc_id, text; others are not read).

    Null, empty and blank texts have an empty set, link with nothing and are their own component. Rows with equal sets
    are always linked. component_id is the smallest doc_id of the component (nulls last; null if it has no other);
    kept says that doc_id equals it, nulls included. Rows that repeat are all returned.
    """
    out = _judged(documents).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(documents: DataFrame) -> DataFrame:
    """One row of documents for each component, with all its columns; rows with an empty set all stay.

    A row is known by doc_id and a hash of its text, so unlike texts with one doc_id, or with none, are judged apart. The
    component's row is the least by doc_id (nulls last), then hash; of rows that have both in common any one stays.
    """
    judged = _judged(documents).where("n_shingles > 0")
    kept = matched(documents, judged.where(~F.col("stays")), "left_anti")
    repeats = checkpointed(judged.where("stays").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1"))
    if repeats.limit(1).count():
        twice = matched(kept, repeats, "left_semi").dropDuplicates(["doc_id", "text"])
        return matched(kept, repeats, "left_anti").unionByName(twice)
    return kept


def _links(own: DataFrame, kinds: DataFrame, centred: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified links (a, b) between nodes: rounds of stars, then the pairs that these left open."""
    nodes = scratch.write(centred.select("node").distinct().join(kinds, "node").select("node", "s1", "s2"), "nodes")
    bits = np.zeros(1 << (NEED_BITS - 6), U64)
    place = F.shiftrightunsigned("s1", 64 - NEED_BITS)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    for word, found in nodes.groupBy(F.shiftrightunsigned(place, 6).alias("w")).agg(F.bit_or(mask).alias("m")).collect():
        bits[word] = found & (2**64 - 1)
    found = own.select("doc_id", "text").mapInArrow(_needed(bits), "s1 long, s2 long, shingles array<long>, odd array<long>")
    found = found.groupBy("s1", "s2").agg(F.first("shingles").alias("shingles"), F.first("odd").alias("odd"))
    sets = scratch.write(found.join(nodes, ["s1", "s2"]).select("node", "shingles", "odd", F.size("shingles").alias("size")), "sets")
    buckets, done, k, roots = centred, None, 0, None
    while True:
        edges = _stars(centred)
        if done is not None:
            edges = edges.join(done.select("a", "b"), ["a", "b"], "left_anti")
        checked = scratch.write(_verify(edges, sets), f"checked-{k}")
        done = checked if done is None else done.unionByName(checked)
        links = done.where("linked").select("a", "b")
        if roots is not None and not checked.where("linked").limit(1).count():
            break
        # Who is in one component with a centre of the bucket is settled there; the rest meet again without the centres.
        roots = checkpointed(components(links))
        rest = centred.where("node != lo and node != hi")
        for end in ("node", "lo", "hi"):
            own = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
            rest = rest.join(own, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
        rest = rest.where("node_root != lo_root and node_root != hi_root")
        rest = scratch.write(rest.select("key", "node"), f"rest-{k}")
        centred = scratch.write(_centred(rest), f"centred-{k}")
        if not centred.limit(1).count():
            break
        k += 1
    edges = _apart(buckets, roots, done, sets.select("node", "size", "odd"), scratch)
    return done.unionByName(scratch.write(_verify(edges, sets), "checked-apart")).where("linked").select("a", "b")
