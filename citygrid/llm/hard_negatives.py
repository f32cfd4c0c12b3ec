"""Hard negatives: for each anchor and positive, rows of other labels that score nearly as high.

Scores are whole numbers: inner products of components floor(256 x). Every row is
rotated once by a fixed random orthogonal matrix and coded by signs, one bit a
dimension, several times over: each stage codes what the stages before left out, and
stores its alignment, the inner product of that rest with its own code vector. An
anchor is cut into bit planes, so inner products of its components with code vectors
are sums of popcounts. They give an estimate, and Cauchy-Schwarz on what the last stage
left out (which is orthogonal to the last code vector) and on what the bit planes lost
gives an interval that holds the score for certain. Rows whose interval cannot matter
are put aside; all others are scored in whole numbers, so coding changes no result.

Anchors are a stated query set, compared with all rows in blocks. Each row goes to a
block by hash, each anchor to a chunk, so no label, anchor or vector is a hot key; a
task returns a few rows for each of its anchors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citygrid.lineage import Shelf


LARGEST, LARGE, PART = 2**63 - 1, 1e300, 32  # anchors of a task are compared so many at a time


@dataclass(frozen=True)
class Settings:
    every: int = 50  # anchors are rows whose id is divisible by it
    positives: int = 5
    negatives: int = 3
    least: int = 50  # percent of the positive's score that a negative's must reach
    most: int = 95  # and must not exceed
    stages: int = 8  # one-bit codes of a row, each of the rest before it
    planes: int = 7  # bits of an anchor's components in estimates
    block: int = 1024
    chunk: int = 1024
    seed: int = 11


@lru_cache(4)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def whole(vectors) -> np.ndarray:
    """Components floor(256 x), exact in double precision."""
    return np.floor(np.stack(list(vectors)).astype(np.float64) * 256)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits -> rows of 64-bit words; missing bits are 0."""
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)


def encode(x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """-> codes (row, stage, word), alignments (row, stage), length of what all stages leave out."""
    rest = x @ rotation(x.shape[1], s.seed)
    codes, aligned, side = [], [], 1 / np.sqrt(x.shape[1])
    for _ in range(s.stages):
        bits = rest >= 0
        sign = np.where(bits, side, -side)
        codes.append(pack(bits))
        aligned.append((rest * sign).sum(1))
        rest = rest - aligned[-1][:, None] * sign
    return np.stack(codes, 1), np.stack(aligned, 1), np.linalg.norm(rest, axis=1)


def intervals(q: np.ndarray, codes: np.ndarray, aligned: np.ndarray, left: np.ndarray, lengths: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of anchors (rows) with coded rows (columns) of the given lengths."""
    dim = q.shape[1]
    turned = q @ rotation(dim, s.seed)
    low = turned.min(1, keepdims=True)
    unit = np.maximum((turned.max(1, keepdims=True) - low) / (2**s.planes - 1), 1e-300)
    level = np.rint((turned - low) / unit).astype(np.int64)
    lost = np.linalg.norm(turned - (low + unit * level), axis=1)[:, None]
    planes = [pack((level >> j & 1).astype(bool)) for j in reversed(range(s.planes))]  # highest first
    held = np.empty((len(q), len(codes)), np.uint32 if codes.shape[2] > 1 else np.uint16)
    met, count = np.empty(held.shape, np.uint64), np.empty(held.shape, np.uint8)
    stages = np.ascontiguousarray(codes.transpose(1, 2, 0))
    ones, side = np.bitwise_count(codes).sum(2, dtype=np.int64), np.sqrt(dim)
    estimate, product = np.zeros(held.shape), np.empty(held.shape)
    for k, stage in enumerate(stages):
        held[:] = 0
        for plane in planes:
            held <<= 1
            for w, word in enumerate(stage):
                held += np.bitwise_count(np.bitwise_and(plane[:, w, None], word, out=met), out=count)
        estimate += np.multiply(held, aligned[:, k], out=product)
    # an inner product is the sum of the components under 1 bits, less those under 0 bits; each is low + unit * level
    total = low * dim + unit * level.sum(1, keepdims=True)
    estimate = (2 * unit * estimate + 2 * low * (aligned * ones).sum(1) - total * aligned.sum(1)) / side
    product = (2 * unit * held + 2 * low * ones[:, -1] - total) / side
    norm = np.linalg.norm(q, axis=1)[:, None]
    aside = np.sqrt(np.maximum(0.0, norm**2 - np.maximum(0.0, np.abs(product) - lost) ** 2))
    room = left * aside + (lengths + left) * lost + 1e-9 * norm * lengths + 1e-6
    known = np.isfinite(estimate) & np.isfinite(room)  # squares of very large components are not
    return np.where(known, estimate - room, -np.inf), np.where(known, estimate + room, np.inf)


def scores(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (rows, cols), sorted by row, as whole numbers; those beyond a
    long as the farthest long."""
    asked, begin = np.unique(rows, return_index=True)
    parts = list(zip(asked, begin, [*begin[1:], len(rows)]))
    if np.abs(q[asked]).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**53:  # then doubles are exact
        return np.concatenate([np.zeros(0), *(x[cols[a:b]] @ q[r] for r, a, b in parts)]).astype(np.int64)
    products = [sum(int(u) * int(v) for u, v in zip(q[r], x[c])) for r, a, b in parts for c in cols[a:b]]
    return np.array([max(-LARGEST, min(LARGEST, v)) for v in products], object)


def first_of(groups: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each group: highest points, then smallest id."""
    order = np.array(sorted(range(len(ids)), key=lambda i: (groups[i], -points[i], ids[i])), int) if points.dtype == object else np.lexsort((ids, -points, groups))
    at = np.flatnonzero(np.r_[True, groups[order][1:] != groups[order][:-1]]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(at, np.diff(np.r_[at, len(order)]))
    return order[rank < k]


def reach(bounds: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """For each row the k-th largest lower bound among those allowed; without k of them, none."""
    if bounds.shape[1] < k:
        return np.full(len(bounds), -np.inf)
    held = np.where(allowed, bounds, -np.inf)
    return np.partition(held, bounds.shape[1] - k, 1)[:, bounds.shape[1] - k]


class Block:
    """A block of coded rows, asked by a chunk of anchors, some at a time."""

    def __init__(self, data: pd.DataFrame, queries: pd.DataFrame, s: Settings):
        self.s, self.id, self.label = s, data["id"].to_numpy(), data["label"].to_numpy()
        self.x, self.q = whole(data["vector"]), whole(queries["q_vector"])
        words = -(-self.x.shape[1] // 64)
        self.codes = np.stack([np.frombuffer(c, np.uint64) for c in data["codes"]]).reshape(len(data), s.stages, words)
        self.aligned, self.left = np.stack(list(data["aligned"])), data["left"].to_numpy()
        self.lengths = np.linalg.norm(self.x, axis=1)
        self.q_id, self.q_label = queries["q_id"].to_numpy(), queries["q_label"].to_numpy()

    def bounds(self, q: np.ndarray, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            return intervals(q, self.codes[rows], self.aligned[rows], self.left[rows], self.lengths[rows], self.s)

    def positives(self) -> pd.DataFrame:
        out = []
        for label in np.unique(self.q_label):
            asked, mine = np.flatnonzero(self.q_label == label), np.flatnonzero(self.label == label)
            for a in range(0, len(asked) if len(mine) else 0, PART):
                part = asked[a : a + PART]
                low, high = self.bounds(self.q[part], mine)
                fits = self.q_id[part][:, None] != self.id[mine]
                rows, cols = np.nonzero(fits & (high >= reach(low, fits, self.s.positives)[:, None]))
                rows, cols = part[rows], mine[cols]
                points = scores(self.q, self.x, rows, cols)
                best = first_of(rows, self.id[cols], points, self.s.positives)
                out.append(pd.DataFrame({"anchor_id": self.q_id[rows[best]], "positive_id": self.id[cols[best]], "positive_score": points[best]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []})

    def negatives(self, wanted: list) -> pd.DataFrame:
        """``wanted``: for each anchor its positives as (positive_id, positive_score)."""
        s, out = self.s, []
        for a in range(0, len(self.q), PART):
            part = slice(a, a + PART)
            (low, high), asked, same = self.bounds(self.q[part]), wanted[part], self.q_label[part][:, None] == self.label
            goals, masks = [], []
            for j in range(max(map(len, asked))):
                has = np.array([len(w) > j for w in asked])
                aim = np.array([w[j]["positive_score"] if len(w) > j else 0 for w in asked])
                floor, ceiling = ((aim * (p / 100.0))[:, None] for p in (s.least, s.most))
                slack = 1e-6 + 1e-12 * np.abs(aim[:, None])
                fits = ~same & has[:, None]
                sure = fits & (low >= floor + slack) & (high <= ceiling - slack)
                bar = np.maximum(floor - slack, reach(low, sure, s.negatives)[:, None])
                goals.append((np.array([w[j]["positive_id"] if len(w) > j else 0 for w in asked]), aim))
                masks.append(fits & (high >= bar) & (low <= ceiling + slack))
            rows, cols = np.nonzero(np.logical_or.reduce(masks)) if masks else (np.zeros(0, int),) * 2
            points = scores(self.q[part], self.x, rows, cols)
            exact = points.dtype == object or any(np.abs(aim.astype(float)).max() >= 2**53 for _, aim in goals)
            for (pid, aim), mask in zip(goals, masks):
                goal, found = (aim[rows].astype(object), points.astype(object)) if exact else (aim[rows], points)
                within = np.flatnonzero(mask[rows, cols] & ((s.least * goal <= 100 * found) & (100 * found <= s.most * goal)).astype(bool))
                best = within[first_of(rows[within], self.id[cols[within]], points[within], s.negatives)]
                out.append(pd.DataFrame({"anchor_id": self.q_id[part][rows[best]], "positive_id": pid[rows[best]], "positive_score": aim[rows[best]], "negative_id": self.id[cols[best]], "negative_score": points[best]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": []})


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """-> id, label, dim, vector: one row per id that takes part, with the label as it counts."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = F.col("vector")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>").alias("vector"))
    fine = given.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGE)))
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    one = fine.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", F.col("row.label").alias("label"), F.col("row.vector").alias("vector"))
    return one.select("id", label.alias("label"), F.size("vector").alias("dim"), "vector")


def hard_negatives(vectors: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """-> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or with a null or non-finite component (256 x has
    to be finite too) take no part. A score beyond a long counts as the farthest long. Where the id is divisible by 7,
    (label + 1) % 10 is the label. Rows of different lengths are not compared. Of rows
    that repeat an id the one with the least label, then vector, counts. Ties of scores
    go to the smaller id. Anchors without a positive, and positives without a negative
    in their range, give no row; nor does a positive with a negative score. An empty
    table gives an empty table. Other columns are ignored.
    """
    shelf = Shelf(vectors.sparkSession)
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"

    def code(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                part = part.copy()
                if dim:
                    codes, aligned, left = encode(whole(part["vector"]), s)
                    part["codes"], part["aligned"], part["left"] = [c.tobytes() for c in codes], list(aligned), left
                    yield part  # rows without components score 0 and are in no range that is not 0

    rows = usable(vectors, id_col, vector_col, label_col).filter("dim > 0")
    placed = shelf.put("placed", rows.mapInPandas(code, f"id long, label long, dim int, vector {kind}, codes binary, aligned array<double>, left double"))
    # a row for each length: into how many blocks its rows and chunks its anchors go
    plan = shelf.put("plan", placed.groupBy("dim").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"), F.ceil(F.count_if(F.col("id") % s.every == 0) / s.chunk).cast("int").alias("chunks")).filter("chunks > 0"))
    salt = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    data = placed.join(plan, "dim").withColumn("block", salt("blocks", 1)).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).drop("blocks", "chunks")
    anchors = placed.filter(F.col("id") % s.every == 0).select("dim", "id", "label", "vector").join(plan, "dim").withColumn("chunk", salt("chunks", 2)).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks", "chunks")
    keys = ["dim", "block", "chunk"]
    asked = lambda df: df.select(*[F.col(c).alias(f"q_{c}") for c in df.columns]).groupBy(*[f"q_{k}" for k in keys])

    def positives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return Block(left, right, s).positives() if len(left) and len(right) else pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []})

    def negatives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return Block(left, right, s).negatives(right["q_wanted"].to_list()).reindex(columns=names) if len(left) and len(right) else pd.DataFrame({n: [] for n in names})

    def best(df: DataFrame, of: list[str], name: str, k: int) -> DataFrame:
        order = Window.partitionBy(*of).orderBy(F.desc(f"{name}_score"), f"{name}_id")
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near = data.groupBy(*keys).cogroup(asked(anchors)).applyInPandas(positives, "anchor_id long, positive_id long, positive_score long")
    mine = best(near, ["anchor_id"], "positive", s.positives).groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("wanted"))
    wanted = anchors.join(shelf.put("positives", mine), "id")
    hard = data.groupBy(*keys).cogroup(asked(wanted)).applyInPandas(negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return best(hard, ["anchor_id", "positive_id", "positive_score"], "negative", s.negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
