"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors: one for each word (hashed), one for each
character n-gram of a word in brackets (hashed), one for each word that repeats the
word before it, and one that every document has. A softmax over the mean gives the
label; numpy stochastic gradient descent fits both layers on a bounded sample of
labelled rows.

The output is linear in the mean, so a fitted model is one number per hash bucket,
and a document's margin is the mean of its features' numbers. Scoring needs no
shuffle: the numbers (``buckets`` floats) go to every task, which memorises words.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrid.llm.common import GenerationalCache, min_rounds

SLICE = 4096  # characters of a word whose n-grams are made at once
LONG = 60  # longer words are not kept


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    shortest: int = 3  # character n-grams from
    longest: int = 4  # to
    dim: int = 10
    epochs: int = 8
    rate: float = 0.5
    rows: int = 800  # labelled documents of each label used for fitting
    seed: int = 7


def features(word: str, s: Settings) -> list[int]:
    """Buckets 0 and 1 are for every document and for repeats; n-grams are of the whole word."""
    return [f for part in slices(word, s) for f in part]


def slices(word: str, s: Settings) -> Iterator[list[int]]:
    """The buckets of a word, those of a long one in parts: each n-gram comes once."""
    room, marked = s.buckets - 2, f"<{word}>"
    yield [2 + zlib.crc32(word.encode()) % room]
    for at in range(0, len(marked), SLICE):
        for n in range(s.shortest, s.longest + 1):
            yield [2 + zlib.crc32(marked[i : i + n].encode()) % room for i in range(at, min(at + SLICE, len(marked) - n + 1))]


def repeats(words: list[str]) -> int:
    return sum(map(operator.eq, words, words[1:]))


def bag(text: str, cache: dict, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """-> distinct buckets of a text and their shares."""
    words = text.split()
    counts = np.bincount(np.fromiter((f for w in words if len(w) <= LONG for f in cache[w]), np.int64), minlength=s.buckets)
    for part in (p for w in words if len(w) > LONG for p in slices(w, s)):
        counts += np.bincount(np.array(part, np.int64), minlength=s.buckets)
    counts[0], counts[1] = 1, repeats(words)
    found = np.flatnonzero(counts)
    return found.astype(np.int32), (counts[found] / counts.sum()).astype(np.float32)


def sample(docs: DataFrame, labelled: DataFrame, label: str, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Feature bags of at most ``2 * s.rows`` labelled documents, those whose id hashes least."""
    picked = None
    for value in (0, 1):
        part = min_rounds(labelled.filter((F.col(label) == value) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.lit(value).alias("_label")).dropDuplicates(["_id"]), "_id", s.rows)
        picked = part if picked is None else picked.unionByName(part)

    def run(batches):
        cache = GenerationalCache(lambda w: features(w, s), 50_000, LONG)
        for batch in batches:
            ids, labels, texts = (c.to_pylist() for c in batch.columns)
            bags = [bag(t or "", cache, s) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b[0] for b in bags], pa.list_(pa.int32())), pa.array([b[1] for b in bags], pa.list_(pa.float32()))], ["_id", "_label", "ids", "shares"])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    chosen = texts.join(F.broadcast(picked), "_id")  # at most 2 * s.rows ids
    return chosen.select("_id", "_label", "_text").mapInArrow(run, "_id long, _label int, ids array<int>, shares array<float>")


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], s: Settings) -> np.ndarray:
    """(label, buckets, shares) -> a number per bucket; positive speaks for label 1."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1, 1, (s.buckets, s.dim)).astype(np.float32) / s.dim
    out = np.zeros((s.dim, 2), np.float32)
    if not bags or len({b[0] for b in bags}) < 2:  # nothing to tell apart
        return np.zeros(s.buckets, np.float32)
    steps, done = s.epochs * len(bags), 0
    for _ in range(s.epochs):
        for k in rng.permutation(len(bags)):
            label, ids, shares = bags[k]
            rate = s.rate * (1 - done / steps)
            done += 1
            mean = shares @ vectors[ids]
            z = mean @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            step = out @ p
            out -= rate * np.outer(mean, p)
            vectors[ids] -= rate * shares[:, None] * step * min(100.0, len(ids))
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)


def train(docs: DataFrame, labelled: DataFrame, label: str = "quality", s: Settings = Settings()) -> np.ndarray:
    """Only (doc_id, text) of ``docs`` and (doc_id, ``label``) of ``labelled`` are read.

    The driver gets feature bags of a bounded number of documents, each of at most
    ``s.buckets`` entries. A document with both labels counts once for each.
    """
    rows = sample(docs, labelled, label, s).toPandas().sort_values(["_id", "_label"])
    return fit([(int(y), np.asarray(i, np.int64), np.asarray(w, np.float32)) for y, i, w in zip(rows["_label"], rows["ids"], rows["shares"])], s)


class Scorer:
    """Scores texts; a word's numbers are summed once and kept."""

    def __init__(self, model: np.ndarray, s: Settings):
        self.model, self.s = model, s
        self.cache = GenerationalCache(self._word, 150_000, LONG)

    def _word(self, word: str) -> complex:
        """The sum of the word's numbers, and (as imaginary part) how many they are."""
        if len(word) > LONG:
            return sum((complex(float(self.model[part].sum(dtype=np.float64)), len(part)) for part in slices(word, self.s)), 0j)
        found = features(word, self.s)
        return complex(float(self.model[found].sum()), len(found))

    def __call__(self, text: str | None) -> float:
        words = (text or "").split()
        both = np.fromiter(map(self.cache.__getitem__, words), np.complex128, len(words)).sum() if words else 0j
        again = repeats(words)
        margin = (both.real + again * float(self.model[1]) + float(self.model[0])) / (both.imag + again + 1)
        return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def _mapped(batches, model, s, made):
    scorer = Scorer(model, s)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield made(part, [scorer(t) for t in part.column(part.num_columns - 1).to_pylist()])


def score(docs: DataFrame, model: np.ndarray, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> id, score (0 to 1, higher: label 1 is likelier), predicted (1 from 0.5).

    Null and empty texts are scored by what every document has, long ones whole. Each row
    gives a row, whatever its id, an empty table none; other columns are ignored.
    """

    def made(part, scores):
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())], [id_col, "score", "predicted"])

    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(lambda b: _mapped(b, sent.value, s, made), f"`{id_col}` long, score double, predicted int")


def keep_good(docs: DataFrame, model: np.ndarray, s: Settings = Settings(), text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns."""
    names = docs.columns

    def made(part, scores):
        keep = pa.array([x >= least for x in scores])
        part = part.filter(keep)
        return pa.RecordBatch.from_arrays(part.columns[:-1], names)

    sent = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").alias("__text"))
    return given.mapInArrow(lambda b: _mapped(b, sent.value, s, made), docs.schema)
