"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context,
only its text is trainable. Turns after the last assistant turn (and conversations
without one) give a last example with no trainable text, so nothing is lost.

Template: ``[INST:role]`` opens a turn, ``[/INST]`` closes it, ``</s>`` ends the
conversation so far. In texts, the control characters ``\\``, ``[``, ``]``, ``<`` and
``>`` are written as ``\\`` and a letter, so no text can look like a mark and
unescaping gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPED = {"\\": "\\b", "[": "\\o", "]": "\\c", "<": "\\l", ">": "\\g"}
TABLE = str.maketrans(ESCAPED)
BACK = {v: k for k, v in ESCAPED.items()}
TURN = re.compile(r"\[INST:((?:[^\[\]])*)\]([^\[\]<>]*)\[/INST\]")
END = "</s>"


def escape(text: str) -> str:
    return text.translate(TABLE)


def unescape(text: str) -> str:
    return re.sub(r"\\[boclg]", lambda m: BACK.get(m[0], m[0]), text)


def turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """-> the formatted turn, and where its text begins and ends in it."""
    head = f"[INST:{escape(role or '')}]"
    body = escape(text or "")
    return f"{head}{body}[/INST]", len(head), len(head) + len(body)


def expand(turns: Iterable[tuple[str | None, str | None]]) -> Iterator[tuple[int, str, int, int]]:
    """(role, text) in order -> (example, formatted, start and end of its trainable text)."""
    context, example, rest = "", 0, False
    for role, text in turns:
        formatted, a, b = turn(role, text)
        if role == "assistant":
            yield example, context + formatted + END, len(context) + a, len(context) + b
            example, rest = example + 1, False
        else:
            rest = True
        context += formatted
    if rest:
        yield example, context + END, 0, 0


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of one example, unescaped."""
    return ((unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted))


def _groups(batches: Iterable[pa.RecordBatch], key: int) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows with one key in sorted input, over the borders of batches, row by row."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda r: r[key])


def _chunks(rows: Iterable[tuple], schema: pa.Schema, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` characters."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += sum(len(x) for x in r if isinstance(x, str)) + 50
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])
READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> examples.

    Result: conv_id, example, formatted, loss_start, loss_end (code points of
    ``formatted``). Turns go by ``turn`` (nulls first), ties by role, then text; null
    roles and texts count as empty; a null conv_id is a conversation of its own; rows that
    repeat a turn are turns of their own; long texts are kept whole; an empty table gives
    none. Other columns are ignored. A task holds one conversation and one example at a time.
    """

    def run(batches):
        yield from _chunks(((conv, *e) for conv, rows in _groups(batches, 0) for e in expand((r[2], r[3]) for r in rows)), EXAMPLES)

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return (
        turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(run, "conv_id long, example int, formatted string, loss_start int, loss_end int")
    )


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation with digests of what its examples say.

    ``examples`` must come from ``format_conversations``, whose partitions hold whole
    conversations in order: no second shuffle. The turns are those of the last
    example, which holds all of them; the trainable text is that under each mask.
    """

    def summary(conv, rows):
        loss, loss_chars, chars, n, last = hashlib.sha256(), 0, 0, 0, ""
        for _, _, formatted, a, b in rows:
            under = unescape(formatted[a:b])
            loss.update(under.encode())
            loss_chars += len(under)
            chars += len(formatted)
            n, last = n + 1, formatted
        turns, n_turns = hashlib.sha256(), 0
        for role, text in parse(last):
            turns.update(f"{role}\n{text}\n".encode())
            n_turns += 1
        return conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n

    def run(batches):
        yield from _chunks((summary(conv, rows) for conv, rows in _groups(batches, 0)), READ)

    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
