"""Words of whole texts as NumPy arrays: the shared tokeniser of the Arrow-side operators.

A word is a maximal run of characters other than space and U+0009 to U+000D; A-Z is lower-cased first. Both rules touch
ASCII bytes only, so they hold on UTF-8 bytes directly and no text is ever decoded. A word is known by a 64-bit hash: a
polynomial over a fixed random byte table, finalised with an avalanche mix. Texts are taken in chunks of about a
megabyte (a longer text is a chunk of its own), which bounds a worker's memory whatever the batch size is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit avalanche finaliser that splitmix64 uses."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_TABLE = mix(np.arange(256, dtype=U64) + U64(0x5EED))[_FOLD] | U64(1)
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the odd base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base & (2**64 - 1), U64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0): whole rows of about `size` bytes at a time."""
    raw, offs = utf8(texts)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    ink = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(raw), bool)
    before[1:] = ink[:-1]
    after = np.zeros(len(raw), bool)
    after[:-1] = ink[1:]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each word, letters A-Z lower-cased."""
    power, inverse = _powers(len(raw))
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, U64)
        np.cumsum(_TABLE[raw] * power[: len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] ^ (ends - starts).astype(U64))


def words(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, index of each row's first word) chunk by chunk."""
    for lo, hi, raw, offs in chunks(texts, size):
        starts, ends, first = spans(raw, offs)
        yield lo, hi, hashes(raw, starts, ends), first


_STEP = mix(np.arange(64, dtype=U64) + U64(77)) | U64(1)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive entries (n at most 64)."""
    if len(h) < n:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, U64)
        for k in range(n):
            out += h[k : len(h) - n + 1 + k] * _STEP[k]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(h).view(np.int64)


def tally(parts: Iterable[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of all parts; about `most` distinct hashes are held, then they are passed on and may come again."""

    def merge(held: list) -> tuple[np.ndarray, np.ndarray]:
        uniq, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return uniq, np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)

    held: list = []
    size = 0
    for part in parts:
        held.append(np.unique(part, return_counts=True))
        size += len(held[-1][0])
        if size > most:
            held = [merge(held)]
            size = len(held[0][0])
            if size > most // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield merge(held)


class Members:
    """Membership of 64-bit hashes in a fixed set: a bit table first, then binary search for what it lets through."""

    def __init__(self, keys: np.ndarray, bits: int = 22) -> None:
        self.keys = np.unique(keys.astype(U64))
        self.shift = U64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are members, and their ranks among the sorted keys."""
        at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        rank = np.searchsorted(self.keys, h[at])
        rank[rank == len(self.keys)] = 0
        hit = self.keys[rank] == h[at]
        return at[hit], rank[hit]
