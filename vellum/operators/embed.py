"""Embeddings and key phrases with an encoder that the caller gives: loaded once in each worker, fed in small batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.scoring import DEFAULT_SEMANTIC
from vellum.functions.taxonomy import Taxonomy
from vellum.session import ship

#: Texts that an encoder is given at once.
BATCH = 32
#: Key phrases of a text, and how much unlike each other they shall be.
PHRASES, DIVERSITY = 30, 0.5
Encode = Callable[[list[str]], np.ndarray]
_LOADED: dict[str, Encode] = {}
_TOKEN = re.compile(r"\b\w\w+\b")


@dataclass(frozen=True)
class Encoder:
    """name: what its vectors are known by in a worker; load: makes the function from texts to rows of vectors."""

    name: str
    load: Callable[[], Encode]

    def encode(self, texts: Sequence[str], size: int = BATCH) -> np.ndarray:
        """Vectors of texts, `size` at a time; a worker process loads the encoder when it first needs it."""
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        parts = [np.asarray(_LOADED[self.name](list(texts[k : k + size])), float) for k in range(0, len(texts), size)]
        return np.concatenate(parts) if parts else np.zeros((0, 0))


def cosines(vectors: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Cosine of each row to one vector; 0 where either has no length."""
    length = np.linalg.norm(vectors, axis=1) * np.linalg.norm(one)
    return np.divide(vectors @ one, length, out=np.zeros(len(vectors)), where=length > 0)


def encoded_scores(texts: DataFrame, job: str, encoder: Encoder | None) -> DataFrame:
    """candidate_id, semantic_score: cosine of each text (candidate_id, text) to the job description; null texts count as empty.

    Without an encoder, or if it fails for the job, every score is the default; if it fails for a batch of texts, theirs are.
    """
    default = texts.select("candidate_id", F.lit(DEFAULT_SEMANTIC).alias("semantic_score"))
    if encoder is None:
        return default
    ship(texts.sparkSession)
    try:
        wanted = encoder.encode([job])[0]
    except Exception:  # noqa: BLE001  whatever a caller's model raises
        return default

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [t or "" for t in batch.column("text").to_pylist()]
            out = np.full(len(said), DEFAULT_SEMANTIC)
            for k in range(0, len(said), BATCH):
                try:
                    out[k : k + BATCH] = cosines(encoder.encode(said[k : k + BATCH]), wanted)
                except Exception:  # noqa: BLE001
                    continue
            yield pa.RecordBatch.from_arrays([batch.column("candidate_id"), pa.array(out)], names=["candidate_id", "semantic_score"])

    return texts.select("candidate_id", "text").mapInArrow(scored, "candidate_id string, semantic_score double")


def phrase_candidates(text: str, stop_words: frozenset[str]) -> list[str]:
    """Words of two letters or more and pairs of them in a row, stop words left out first; each once, by alphabet."""
    words = [w for w in _TOKEN.findall(text.lower()) if w not in stop_words]
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


def diverse(vectors: np.ndarray, whole: np.ndarray, most: int = PHRASES, diversity: float = DIVERSITY) -> list[int]:
    """Rows by maximal marginal relevance: first the one nearest to `whole`, then always the one that is near to it and far from those chosen.

    The likeness to the chosen ones is kept up to date, so a choice costs one product. Ties go to the lower row.
    """
    if not len(vectors):
        return []
    near = cosines(vectors, whole)
    chosen, like = [int(np.argmax(near))], np.full(len(vectors), -np.inf)
    while len(chosen) < min(most, len(vectors)):
        like = np.maximum(like, cosines(vectors, vectors[chosen[-1]]))
        worth = (1 - diversity) * near - diversity * like
        worth[chosen] = -np.inf
        chosen.append(int(np.argmax(worth)))
    return chosen


def key_phrases(texts: DataFrame, encoder: Encoder, stop_words: frozenset[str] = frozenset(), most: int = PHRASES, diversity: float = DIVERSITY) -> DataFrame:
    """candidate_id, phrases (in order of choice) of each text (candidate_id, text); none for blank and null texts."""
    ship(texts.sparkSession)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found = phrase_candidates(text or "", stop_words)
                out.append([found[k] for k in diverse(encoder.encode(found), encoder.encode([text])[0], most, diversity)] if found else [])
            yield pa.RecordBatch.from_arrays([batch.column("candidate_id"), pa.array(out, pa.list_(pa.string()))], names=["candidate_id", "phrases"])

    return texts.select("candidate_id", "text").mapInArrow(of, "candidate_id string, phrases array<string>")


def merge_phrases(skills: DataFrame, phrases: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """skills (candidate_id, skills map) with the names that key phrases spell and no category has yet, at the end of their category, in order of the phrases.

    A name goes to the first category that has it. Other phrases are left out, and rows without phrases stay as they are.
    """
    spark = skills.sparkSession
    first: dict[str, str] = {}
    for category, names in taxonomy.names.items():
        for name in names:
            first.setdefault(name, category)
    rows = [(s, first[n[-1]], n[-1]) for s, n in taxonomy.spellings().items() if n[-1] in first]
    names = spark.createDataFrame(rows, "phrase string, category string, name string")
    each = phrases.select("candidate_id", F.posexplode("phrases").alias("place", "phrase")).join(F.broadcast(names), "phrase")
    found = each.groupBy("candidate_id", "category", "name").agg(F.min("place").alias("place")).groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("place", "category", "name"))).alias("more"))
    own = skills.join(found, "candidate_id", "left")
    already = F.flatten(F.map_values("skills"))
    more = lambda c: F.transform(F.filter("more", lambda m: (m["category"] == c) & ~F.array_contains(already, m["name"])), lambda m: m["name"])
    merged = F.transform_values("skills", lambda c, have: F.concat(have, F.coalesce(more(c), F.array().cast("array<string>"))))
    return own.withColumn("skills", merged).select(*skills.columns)
