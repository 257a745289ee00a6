"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The vocabulary comes from a public model file (its path is a parameter; nothing is trained): pieces, scores, byte pieces
and the options for white space. The file must be of type unigram. A byte-pair file, whose scores are merge ranks and no
probabilities, is turned into one by `unigram`: merges are made in order of frequency, so a piece's log probability is
taken from its rank by the Zipf-Mandelbrot law. The trie maps UTF-8 bytes; Viterbi keeps the best-scoring split of each stretch. A
character without a piece becomes its byte pieces at a score below every piece's. Stretches are cut where no piece can
cross: before a marker that follows another character, around characters that only stand alone, and between neighbours
that stand together in no piece. Pieces of stretches are remembered in bounded tables, so common ones are split once.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: How far under the lowest piece an unknown character scores.
UNKNOWN_PENALTY = 10.0
#: Stretches whose pieces a worker remembers, twice: when the newer table is full it becomes the older one, from which those
#: that are met again come back.
REMEMBERED = 1 << 18
#: Zipf-Mandelbrot: the probability of the piece of rank r is in proportion to 1 / (r + SHIFT).
SHIFT = 2.7
#: Types of a model file (trainer spec, field 3).
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer message: varints as int, 32- and 64-bit and length-delimited ones as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def model_type(data: bytes) -> int:
    """The type that the file's trainer spec names; unigram if it names none."""
    spec = next((v for k, v in _fields(data) if k == 2), b"")
    return dict(_fields(spec)).get(3, UNIGRAM)


def _message(field: int, data: bytes) -> bytes:
    size, n = bytearray(), len(data)
    while n > 127:
        size.append(n & 127 | 128)
        n >>= 7
    return bytes([field << 3 | 2]) + bytes(size) + bytes([n]) + data


def unigram(data: bytes) -> bytes:
    """The model file as one of type unigram. A byte-pair file's normal pieces get log probabilities by rank (best score
    first, then id); a unigram file stays as it is. Other types are refused."""
    kind = model_type(data)
    if kind == UNIGRAM:
        return data
    if kind != BPE:
        raise ValueError(f"a model of type {kind} has no scores to rank pieces by")
    fields = list(_fields(data))
    pieces = [dict(_fields(v)) for k, v in fields if k == 1]
    score = [np.frombuffer(p.get(2, bytes(4)), "<f4")[0] for p in pieces]
    ranked = sorted((k for k, p in enumerate(pieces) if p.get(3, NORMAL) == NORMAL), key=lambda k: (-score[k], k))
    weight = 1 / (np.arange(1, len(ranked) + 1) + SHIFT)
    log = dict(zip(ranked, np.log(weight / weight.sum()).tolist(), strict=True))
    out = []
    for k, p in enumerate(pieces):
        own = _message(1, p.get(1, b"")) + b"\x15" + struct.pack("<f", log.get(k, 0.0)) + b"\x18" + bytes([p.get(3, NORMAL)])
        out.append(_message(1, own))
    # The last of a field's values counts.
    out += [_message(k, v + b"\x18\x01" if k == 2 else v) for k, v in fields if k != 1 and isinstance(v, bytes)]
    return b"".join(out)


class Trie:
    """Double-array trie over bytes: child of s by b is t = base[s] + b + 1 if check[t] == s; value[t] is an id or -1.

    A state without children has its base in the free end of the arrays, where no check agrees.
    """

    def __init__(self, keys: dict[bytes, int]) -> None:
        root: dict = {}
        for key, value in keys.items():
            node = root
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 17
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        # Nodes of one child fill the first gap (past 257, so that any byte fits); others search from where the last long search ended.
        free_from, dense, todo, leaves = 258, 258, [(0, root)], []
        while todo:
            state, node = todo.pop()
            kids = sorted(b for b in node if b >= 0)
            if -1 in node:
                self.value[state] = node[-1]
            if not kids:
                leaves.append(state)
                continue
            while self.check[free_from] >= 0:
                free_from += 1
            tried, base = 0, max(0, (free_from if len(kids) == 1 else max(free_from, dense)) - kids[0] - 1)
            while True:
                if base + 258 >= size:
                    grow = size
                    self.base += [0] * grow
                    self.check += [-1] * grow
                    self.value += [-1] * grow
                    size += grow
                if base + kids[0] + 1 > 0 and all(self.check[base + b + 1] < 0 for b in kids):
                    break
                base += 1
                tried += 1
            if tried > 64 and len(kids) > 1:
                dense = base + kids[0] + 1
            self.base[state] = base
            for b in kids:
                self.check[base + b + 1] = state
            todo += [(base + b + 1, node[b]) for b in kids]
        end = len(self.check)
        for state in leaves:
            self.base[state] = end
        self.base += [0] * 258
        self.check += [-1] * 258
        self.value += [-1] * 258


class Pieces:
    """A vocabulary and its encoder and decoder."""

    def __init__(self, data: bytes) -> None:
        if model_type(data) != UNIGRAM:
            raise ValueError("not a unigram model: its scores are no log probabilities")
        self.pieces: list[tuple[str, float, int]] = []
        self.dummy_prefix = self.escape = True
        self.squeeze = True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                score = float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0
                self.pieces.append((f.get(1, b"").decode(), score, f.get(3, NORMAL)))
            elif number == 3:
                f = dict(_fields(value))
                self.dummy_prefix, self.squeeze, self.escape = (bool(f.get(k, 1)) for k in (3, 4, 5))
        usable = {p: k for k, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER) and p}
        self.scores = [s for _, s, _ in self.pieces]
        self.unknown = next((k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.low = min((self.scores[k] for k in usable.values()), default=0.0) - UNKNOWN_PENALTY
        self.trie = Trie({p.encode(): k for p, k in usable.items()})
        # What decoding writes for each id.
        self.out = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]
        # A character in no piece of two or more stands alone. No piece has a marker after another character, or
        # stretches are not cut at all.
        social = {c for p in usable if len(p) > 1 for c in p}
        inner = any(MARK in p.lstrip(MARK) for p in usable)
        self.social = frozenset(social)
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in social)
        self.cut = re.compile(f"(?:{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+|[{alone}])" if alone else f"(?:{MARK}+[^{MARK}]*|[^{MARK}]+)") if not inner else None
        self.pairs = frozenset(p[k : k + 2] for p in usable for k in range(len(p) - 1))
        self.seen: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best split of one stretch. Ties: the split found first from the left."""
        data = text.encode()
        n = len(data)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        best = [-1e300] * (n + 1)
        best[0] = 0.0
        last = [0] * (n + 1)
        piece = [-1] * (n + 1)
        at = 0
        while at < n:
            here = best[at]
            b = data[at]
            width = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            state, whole = 0, False
            for end in range(at, n):
                to = base[state] + data[end] + 1
                if check[to] != state:
                    break
                state = to
                if (k := value[state]) >= 0:
                    if end + 1 - at == width:
                        whole = True
                    if (s := here + scores[k]) > best[end + 1]:
                        best[end + 1], last[end + 1], piece[end + 1] = s, at, k
            if not whole and (s := here + self.low) > best[at + width]:
                best[at + width], last[at + width], piece[at + width] = s, at, -1
            at += width
        ids: list[int] = []
        end = n
        while end:
            start = last[end]
            if (k := piece[end]) >= 0:
                ids.append(k)
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(data[start:end])]
            else:
                ids.append(self.unknown)
            end = start
        return ids[::-1]

    def normalise(self, text: str) -> str:
        """White space as the model asks for: spaces become markers, one is put in front."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def encode_bytes(self, text: str) -> bytes:
        """Ids as 32-bit little-endian integers."""
        text = self.normalise(text)
        if self.cut is None:
            return np.array(self.viterbi(text), "<i4").tobytes()
        out = []
        for stretch in self.cut.findall(text):
            ids = self.seen.get(stretch)
            if ids is None:
                ids = self._remember(stretch)
            out.append(ids)
        return b"".join(out)

    def _parts(self, stretch: str) -> list[str]:
        """The stretch, cut between neighbours that stand together in no piece."""
        pairs, start, out = self.pairs, 0, []
        for k in range(1, len(stretch)):
            if stretch[k - 1 : k + 1] not in pairs:
                out.append(stretch[start:k])
                start = k
        out.append(stretch[start:])
        return out

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            found = self.viterbi(part)
            ids = struct.pack(f"<{len(found)}i", *found)
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            if len(part) <= 64:
                self.parts[part] = ids
        return ids

    def _remember(self, stretch: str) -> bytes:
        ids = self.older.get(stretch)
        if ids is None:
            ids = b"".join(map(self._part, self._parts(stretch)))
        if len(stretch) <= 64:
            if len(self.seen) >= REMEMBERED:
                self.older, self.seen = self.seen, {}
            self.seen[stretch] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: markers become spaces, byte pieces bytes (wrong UTF-8 is replaced), the front space goes."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def load(data: bytes) -> Pieces:
    return Pieces(data)


def read_model(path: str = MODEL) -> bytes:
    """The model file as one of type unigram, read on the driver; tasks get its bytes."""
    with open(os.fspath(path), "rb") as f:
        return unigram(f.read())


ENCODED = "doc_id long, n_chars long, n_pieces long, n_bytes long, ids_sha256 string, ids array<int>, round_trip boolean"


def encode_documents(documents: DataFrame, model: bytes | None = None, keep_ids: bool = True) -> DataFrame:
    """ENCODED of each row of documents (doc_id, text; others are not read), without ids if keep_ids is false.

    n_bytes counts byte pieces; ids_sha256 digests the ids as 32-bit little-endian integers; round_trip says that
    decoding the ids gives the text back. model: a unigram file's bytes, MODEL if None. Null and empty texts have no pieces. Repeated rows stay.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model or read_model())
    fields = [f for f in ENCODED.split(", ") if keep_ids or not f.startswith("ids ")]
    names = [f.split()[0] for f in fields]

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(shared.value)
        is_byte = np.zeros(len(pieces.pieces), bool)
        is_byte[list(pieces.bytes.values())] = True
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                cols: dict[str, list] = {n: [] for n in names}
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    text = text or ""
                    packed = pieces.encode_bytes(text)
                    ids = np.frombuffer(packed, "<i4")
                    row = {"doc_id": doc_id, "n_chars": len(text), "n_pieces": len(ids), "n_bytes": int(is_byte[ids].sum()), "ids_sha256": hashlib.sha256(packed).hexdigest(), "ids": ids, "round_trip": pieces.decode(ids.tolist()) == text}
                    for n in names:
                        cols[n].append(row[n])
                kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_()}
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.split()[0]], kinds[f.split()[1]]) for f in fields], names=names)

    return documents.select("doc_id", "text").mapInArrow(encoded, ", ".join(fields))
