r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, then that reply, which alone is
trainable. Template: `<turn role="ROLE">\nTEXT\n</turn>\n`. Inside roles and texts a backslash is written `\\`, `<` is
written `\l` and `"` is written `\q`, so no text can forge a control string and reading back restores it exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLES = "conv_id long, position long, target_turn long, formatted string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Characters in one Arrow batch of examples.
BATCH_CHARS = 1 << 22
_TURN = re.compile(r'<turn role="([^"<]*)">\n([^<]*)\n</turn>\n')
_PLAIN = {"\\": "\\", "l": "<", "q": '"'}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace('"', "\\q")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The turn as marked text, and where in it the (escaped) text starts."""
    head = f'<turn role="{escape(role)}">\n'
    return f"{head}{escape(text)}\n</turn>\n", len(head)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; raises on anything that the template didn't write."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation at {at}")
    return found


def expand(turns: Iterable[dict]) -> Iterator[tuple[int | None, str, int, int]]:
    """(target turn, formatted, loss start, loss end) of each example of one conversation, in order.

    A conversation that doesn't end with an assistant turn ends with a row without target, whose text is the whole of it.
    """
    done, tail = "", True
    for x in turns:
        text, head = format_turn(x["role"], x["text"])
        start, done = len(done) + head, done + text
        if tail := x["role"] != "assistant":
            continue
        yield x["turn"], done, start, start + len(escape(x["text"]))
    if tail:
        yield None, done, len(done), len(done)


def _expand_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in EXAMPLES.split(", ")]
    kinds = pa.schema([(n, pa.string() if n == "formatted" else pa.int64()) for n in names])
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for conv, turns in zip(*(c for c in batch.columns), strict=True):
            for k, example in enumerate(expand(turns.as_py())):
                rows.append((conv.as_py(), k, *example))
                held += len(example[1])
                if held > BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], kinds)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], kinds)


def expand_turns(conversations: DataFrame) -> DataFrame:
    """Examples (EXAMPLES) of conversations (conv_id, turn, role, text; other columns are not read).

    Turns are ordered by (turn, role, text), nulls first; repeated rows stay; null roles and texts count as empty. Rows
    without conv_id form one conversation. One task reads one conversation whole, since each example contains all that
    precedes it. Examples of a conversation are adjacent and in order of position within a partition.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(_expand_batches, EXAMPLES)


class _Reader:
    """Digests of one conversation, from its examples."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.whole, self.loss, self.chars = conv, "", hashlib.sha256(), 0

    def add(self, formatted: str, start: int, end: int) -> None:
        said = unescape(formatted[start:end])
        self.loss.update(said.encode())
        self.chars += len(said)
        self.whole = formatted

    def row(self) -> dict:
        turns = read_turns(self.whole)
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        return {"conv_id": self.conv, "n_turns": len(turns), "turns_sha256": digest, "loss_chars": self.chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": len(self.whole)}


def _read_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in DIGESTS.split(", ")]
    kinds = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
    reader, rows = None, []
    for batch in batches:
        for x in batch.to_pylist():
            if x["position"] == 0:
                rows += [reader.row()] if reader else []
                reader = _Reader(x["conv_id"])
            reader.add(x["formatted"], x["loss_start"], x["loss_end"])
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)
            rows = []
    if reader:
        yield pa.RecordBatch.from_pylist([reader.row()], kinds)


def digest_examples(examples: DataFrame) -> DataFrame:
    """DIGESTS of each conversation, read back from the examples that expand_turns returned (not dealt anew since)."""
    return examples.mapInArrow(_read_batches, DIGESTS)
