"""Personal data: exact base rules, then contextual extraction bootstrapped from them.

Base kinds are e-mail, IP address, card and phone number; a digest-like word (32 hexadecimal digits or more) is a further
seed. The two words before an identifier-like word (one with a digit or @) are its lexical pattern, the word its instance.
Spark scores the graph of patterns and instances in ROUNDS rounds: a pattern's score is the confidence of its instances
over all its occurrences in the corpus, an instance's the noisy-or of its patterns' scores, seeds staying at 1. Patterns
with MIN_INSTANCES distinct instances and a score of MIN_SCORE extract every identifier-like word that follows them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._stage import Scratch, checkpointed
from vellum.llm._words import hashes, runs, signed, spans, tally, utf8, words

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_INSTANCES, MIN_SCORE = 3, 3, 0.5
#: log2 of the bits, at most, of the table that says which pairs of words are patterns (16 MB).
MOST_BITS = 27
#: Distinct pairs that a task holds before it passes partial counts on.
PARTIAL = 1 << 20
BASE = "rid long, doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base array<struct<kind:int,start:int,end:int>>"
FOUND = "candidates array<struct<pattern:long,instance:long,seed:boolean,start:int,end:int>>"
U64 = np.uint64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A number's first digit is the first of its run of digits: a later start in the same run meets the same end.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGEST = re.compile(r"[0-9A-Fa-f]{32,}")
_WORD = re.compile(r"[^ \t-\r]+")
_INSTANCE = re.compile(r"[0-9@]")
#: What may enclose an identifier and is no part of it.
_EDGES = "\"'`()[]{}<>,;:.!?#$%&*|"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each @."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind, then start; code points, end exclusive."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return found
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool, int, int]]:
    """(pattern, instance, seed, start, end) of the identifier-like words that two words precede."""
    if not _INSTANCE.search(text):
        return []
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = spans(raw, np.array([0, len(raw)]))
    h = hashes(raw, starts, ends)
    before = runs(h, 2)
    out = []
    for k, m in enumerate(_WORD.finditer(text)):
        if k < 2 or not _INSTANCE.search(m[0]):
            continue
        core = m[0].strip(_EDGES)
        if not core or not _INSTANCE.search(core):
            continue
        start = m.start() + m[0].index(core)
        end = start + len(core)
        seed = bool(_DIGEST.fullmatch(core)) or any(a < end and start < b for _, a, b in base)
        digest = int.from_bytes(hashlib.blake2b(core.encode(), digest_size=8).digest(), "big", signed=True)
        out.append((int(signed(before[k - 2 : k - 1])[0]), digest, seed, start, end))
    return out


def _suspects(texts: pa.Array) -> np.ndarray:
    """Which texts hold a digit or @: no span or candidate can be in another."""
    raw, offs = utf8(texts)
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(((raw >= 48) & (raw <= 57)) | (raw == 64), out=total[1:])
    return total[offs[1:]] > total[offs[:-1]]


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    rid = TaskContext.get().partitionId() << 40
    names = [f.split()[0] for f in (BASE + ", " + FOUND.replace(", ", ",")).split(", ")]
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    mark = pa.list_(pa.struct([("pattern", pa.int64()), ("instance", pa.int64()), ("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            n = part.num_rows
            base: list[list] = [[] for _ in range(n)]
            marks: list[list] = [[] for _ in range(n)]
            texts = part.column("text")
            for k in np.flatnonzero(_suspects(texts)):
                text = texts[int(k)].as_py()
                base[k] = base_spans(text)
                marks[k] = candidates(text, base[k])
            counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in range(4)]
            cols = [pa.array(np.arange(rid, rid + n)), part.column("doc_id").cast(pa.int64()), part.column("text_hash"), *counts]
            cols.append(pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in b] for b in base], span))
            cols.append(pa.array([[dict(zip(("pattern", "instance", "seed", "start", "end"), s, strict=True)) for s in b] for b in marks], mark))
            rid += n
            yield pa.RecordBatch.from_arrays(cols, names=names)


def _occurrences(table: np.ndarray):
    """How often pairs of words, whose hash hits the table of bits, come before a third word: (pattern, n)."""
    shift = U64(64 - int(table.size).bit_length() - 5)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for _, _, h, first in words(batch.column("text")):
                    pairs = runs(h, 2)
                    # A pair must lie in one text and have a word after it there.
                    inside = np.ones(len(h) + 1, bool)
                    inside[np.concatenate([first, np.maximum(first - 1, 0), np.maximum(first - 2, 0)])] = False
                    inside[first[:-1][np.diff(first) > 2]] = True
                    pairs = pairs[inside[: len(pairs)]]
                    at = pairs >> shift
                    yield pairs[(table[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)]

        for key, n in tally(parts(), PARTIAL):
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(n)], names=["pattern", "n"])

    return of


def bit_table(patterns: DataFrame, n: int) -> np.ndarray:
    """Bits, 16 for each of n patterns, within bounds: that of a pattern's highest bits is set. 64 to a word."""
    bits = min(MOST_BITS, max(12, (16 * n).bit_length()))
    place = F.shiftrightunsigned("pattern", 64 - bits)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    got = patterns.groupBy(F.shiftrightunsigned(place, 6).alias("w")).agg(F.bit_or(mask).alias("m")).toArrow()
    table = np.zeros(1 << (bits - 6), U64)
    table[got.column("w").to_numpy()] = got.column("m").to_numpy().view(U64)
    return table


def accepted_patterns(documents: DataFrame, marks: DataFrame, scratch: Scratch) -> DataFrame:
    """(pattern, score) of the patterns that extract. marks: pattern, instance, seed of each candidate occurrence."""
    edges = marks.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    support = edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.max("seed").alias("seeded")).where(F.col("instances") >= MIN_INSTANCES)
    # A pattern without a seed can't start, but it may gain from instances that other patterns raise.
    edges = scratch.write(edges.join(support.select("pattern"), "pattern"), "edges")
    patterns = scratch.write(support.select("pattern"), "patterns")
    # One scan, whatever the number of patterns: what hits the table by chance is dropped by the join.
    table = documents.sparkSession.sparkContext.broadcast(bit_table(patterns, patterns.count()))
    counted = documents.select("text").mapInArrow(lambda batches: _occurrences(table.value)(batches), "pattern long, n long")
    counted = counted.groupBy("pattern").agg(F.sum("n").alias("total")).join(patterns, "pattern", "left_semi")
    counted = scratch.write(counted, "totals")
    instances = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("confidence"))
    for _ in range(ROUNDS):
        scores = edges.join(instances, "instance").groupBy("pattern").agg(F.sum(F.col("n") * F.col("confidence")).alias("mass"))
        scores = scores.join(counted, "pattern").select("pattern", F.least(F.lit(1.0), F.col("mass") / F.greatest("total", F.lit(1))).alias("score"))
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))
        instances = edges.join(scores, "pattern").groupBy("instance").agg(F.when(F.max("seed"), 1.0).otherwise(1 - doubt).alias("confidence"))
        instances = checkpointed(instances)
    return scores.where(F.col("score") >= MIN_SCORE)


def find_personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, base counts, base (kind, start, end) and found (the method's spans) of each row (doc_id, text).

    Null and empty texts have none. Rows that repeat stay; other columns are not read. found holds extracted words that
    overlap no base span, in order.
    """
    own = documents.select("doc_id", "text")
    with Scratch(documents.sparkSession) as scratch:
        hashed = own.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        rows = scratch.write(hashed.mapInArrow(_scan, f"{BASE}, {FOUND}"), "rows")
        marks = rows.select("rid", "base", F.explode("candidates").alias("c")).select("rid", "base", "c.*")
        accepted = checkpointed(accepted_patterns(own, marks, scratch))
        clear = ~F.exists("base", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"]))
        hits = marks.where(clear).join(accepted.select("pattern"), "pattern")
        hits = hits.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("found"))
        hits = hits.withColumnRenamed("rid", "hit")
        out = rows.drop("candidates").join(hits, F.col("rid") == F.col("hit"), "left")
        none = F.array().cast("array<struct<start:int,end:int>>")
        return checkpointed(out.select("doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base", F.coalesce("found", none).alias("found")))


def span_text(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined; spans are structs of kind (string), start and end."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from find_personal_data."""
    name = F.array(*map(F.lit, KINDS))
    base = F.transform("base", lambda s: F.struct(F.get(name, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    more = F.transform("found", lambda s: F.struct(F.lit("id").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.concat(base, more)).alias("spans"))


def mask(text: str, places: list[tuple[int, int, str]]) -> str:
    """The text with each place (start, end, kind) replaced by [KIND]; overlapping places are joined, the first's kind stands."""
    out, last = [], 0
    for start, end, kind in sorted(places):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join(out) + text[last:]


def _mask_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [mask(t, [tuple(map(s.get, ("start", "end", "kind"))) for s in spans_]) if spans_ else t for t, spans_ in zip(batch.column("text").to_pylist(), batch.column("vellum_spans").to_pylist(), strict=True)]
        arrays = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:-1])]
        yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1])


def masked(documents: DataFrame) -> DataFrame:
    """documents with every span that find_personal_data finds replaced in text; same columns and rows.

    Spans are found by doc_id and a hash of the text. Only texts with a digit or @ meet them in a join; no other text
    moves or changes.
    """
    found = find_personal_data(documents).where("size(base) + size(found) > 0").dropDuplicates(["doc_id", "text_hash"])
    name = F.array(*map(F.lit, KINDS))
    base = F.transform("base", lambda s: F.struct(F.get(name, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    more = F.transform("found", lambda s: F.struct(F.lit("id").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    found = found.select(F.col("doc_id").alias("vellum_id"), F.col("text_hash").alias("vellum_hash"), F.concat(base, more).alias("vellum_spans"))
    suspect = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    some = documents.where(suspect).withColumn("vellum_text", F.xxhash64("text"))
    some = some.join(found, F.col("doc_id").eqNullSafe(F.col("vellum_id")) & (F.col("vellum_text") == F.col("vellum_hash")), "left")
    some = some.select(*documents.columns, "vellum_spans").mapInArrow(_mask_batches, documents.schema)
    return documents.where(~suspect).unionByName(some)
