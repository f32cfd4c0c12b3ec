"""Near duplicates among embeddings by product quantisation.

Unit vectors are put into inverted lists by their nearest coarse centre; what is left
after the centre is coded in sub-spaces, one byte each. A query looks into its nearest
lists, estimates the inner product of every code from a table (asymmetric distances),
and works out the exact cosine in double precision of all whose estimate plus the
code's own error reaches the threshold, so coding hides no link.

How many lists are enough is measured on the fitted index: pairs that lie exactly at
the threshold are made from the sample, and the probes are so many that ``recall`` of
them are found from one of their two sides. A link found from one side alone counts for
both: each vector comes with the lists that it looks into itself, so a task knows
whether the other side will find the link too. Up to as many lists as are probed, the
search is exact; lists that two bounds (see ``Index.reached``) exclude are left out.

Equal vectors are compared once and counted with their number. Lists are cut into
blocks and their queries into chunks, so a task never holds more than a block and a
chunk; it returns counts and a spanning forest of its links, never pairs. Vectors of
different lengths never link: each length with rows enough for two lists has an
index of its own, each other length is one exact list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrid.graph import connected_components
from citygrid.lineage import cut
from citygrid.llm.common import min_rounds


@dataclass(frozen=True)
class Settings:
    sample: int = 4096  # rows that the index is fitted on, or 24 for each list, up to 65,536
    per_list: int = 500  # rows a list should get
    most_lists: int = 4096
    recall: float = 0.995  # of pairs exactly at the threshold
    spaces: int = 8
    words: int = 64  # code words of a sub-space
    block: int = 4000
    seed: int = 3


def units(vectors) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that no square is lost."""
    x = np.stack(list(vectors)).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (centres**2).sum(1) - 2 * x @ centres.T
        home = near.argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(home, minlength=len(centres))
        np.add.at(sums, home, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Index:
    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]
    first: int = 0  # number of its first list
    probes: int = 1

    def home(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(1) - 2 * x @ self.centres.T).argmin(1)

    def apart(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """The distance of each vector from its list's centre."""
        return np.sqrt(((x - self.centres[home]) ** 2).sum(1))

    def reached(self, x: np.ndarray, home: np.ndarray, least: np.ndarray, most: np.ndarray, threshold: float) -> np.ndarray:
        """Which of the ``probes`` nearest lists (columns) can hold a unit vector whose cosine with ``x`` is at least ``threshold``.

        ``least`` and ``most``: distances of a list's vectors from its centre. Vectors
        of a list lie in that shell, and on its centre's side of the plane halfway
        between it and any other centre, here that of ``x``.
        """
        far = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
        gaps = lambda a: np.maximum((a**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * a @ self.centres.T, 0)
        square, between = gaps(x), np.sqrt(gaps(self.centres[home]))
        distance = np.sqrt(square)
        beyond = (square - square[np.arange(len(x)), home][:, None]) <= 2 * far * between + 1e-6
        near = np.ones(square.shape, bool)
        if self.probes < len(self.centres):
            near = square <= np.partition(square, self.probes - 1, 1)[:, self.probes - 1, None]
        return near & (distance - most <= far) & (least - distance <= far) & beyond

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """-> codes, and the length of what each code leaves out."""
        rest = x - self.centres[home]
        codes, missed = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = ((book**2).sum(1) - 2 * part @ book.T).argmin(1)
            missed += ((part - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(missed)

    def estimate(self, q: np.ndarray, of_list: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with coded vectors of one list, from tables."""
        out = np.repeat((q @ self.centres[of_list])[:, None], len(codes), 1)
        for m, book in enumerate(self.books):
            out += (q[:, self.cuts[m] : self.cuts[m + 1]] @ book.T)[:, codes[:, m]]
        return out


def fit(x: np.ndarray, rows: int, s: Settings) -> Index:
    rng = np.random.default_rng(s.seed)
    dim = x.shape[1]
    lists = int(np.clip(rows // s.per_list, 1, min(s.most_lists, len(x))))
    centres = kmeans(x, lists, rng)
    cuts = np.linspace(0, dim, min(s.spaces, dim) + 1).astype(int).tolist()
    rest = x - centres[((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)]
    return Index(centres, [kmeans(rest[:, a:b], min(s.words, 256), rng) for a, b in zip(cuts, cuts[1:])], cuts)


def enough_probes(index: Index, x: np.ndarray, threshold: float, s: Settings) -> int:
    """Lists to look into so that ``s.recall`` of pairs at the threshold are found from either side."""
    rng = np.random.default_rng(s.seed)
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-12)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * other
    squares = (index.centres**2).sum(1)
    rank = []
    for at in range(0, len(x), 512):
        near = [squares - 2 * side[at : at + 512] @ index.centres.T for side in (x, y)]
        rows = np.arange(len(near[0]))
        home = [n.argmin(1) for n in near]
        rank.append(np.minimum((near[0] < near[0][rows, home[1]][:, None]).sum(1), (near[1] < near[1][rows, home[0]][:, None]).sum(1)))
    return int(np.quantile(np.concatenate(rank), s.recall, method="higher")) + 1


def compare(data: pd.DataFrame, queries: pd.DataFrame, index: Index | None, of_list: int, threshold: float) -> pd.DataFrame:
    """Links of a chunk of queries into a block of one list: (id, n, to) per query or
    linked vector; ``n`` counts copies, ``to`` spans the links' components. Without an
    index every pair is worked out."""
    d, q = units(data["vector"]), units(queries["q_vector"])
    did, qid, weight, q_weight = data["id"].to_numpy(), queries["q_id"].to_numpy(), data["copies"].to_numpy(), queries["q_copies"].to_numpy()
    if index:
        codes, missed = np.stack([np.frombuffer(c, np.uint8) for c in data["codes"]]), data["missed"].to_numpy()
    homes, of_home = np.unique(queries["q_home"].to_numpy(), return_inverse=True)
    looks = pd.DataFrame({"row": np.repeat(np.arange(len(d)), data["lists"].map(len)), "list": np.concatenate(data["lists"].to_list())})
    looks = looks[looks["list"].isin(homes)]
    finds = np.zeros((len(d), len(homes)), bool)  # whether a vector looks into a query's list itself
    finds[looks["row"], np.searchsorted(homes, looks["list"])] = True
    n, back = np.zeros(len(q), np.int64), np.zeros(len(d), np.int64)
    dto, qto = did.copy(), qid.copy()
    linked: list[tuple[slice, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), 256):
        part = slice(a, a + 256)
        maybe = index.estimate(q[part], of_list - index.first, codes) + missed >= threshold - 1e-9 if index else np.ones((len(q[part]), len(d)), bool)
        cols = np.flatnonzero(maybe.any(0))
        if len(cols):
            hit = (q[part] @ d[cols].T >= threshold) & maybe[:, cols] & (qid[part][:, None] != did[cols])
            n[part] = hit @ weight[cols]
            back[cols] += q_weight[part] @ (hit & ~finds[cols][:, of_home[part]].T)
            keep = hit.any(0)
            if keep.any():
                linked.append((part, cols[keep], hit[:, keep]))
    high = np.iinfo(np.int64).max
    changed = bool(linked)
    while changed:  # least id over the links, from queries to data and back
        changed = False
        for part, cols, hit in linked:
            to_d = np.minimum(dto[cols], np.where(hit, qto[part][:, None], high).min(0))
            to_q = np.minimum(qto[part], np.where(hit, to_d, high).min(1))
            changed |= bool((to_d != dto[cols]).any() or (to_q != qto[part]).any())
            dto[cols], qto[part] = to_d, to_q
    out = pd.DataFrame({"id": np.concatenate([qid, did]), "n": np.concatenate([n, back]), "to": np.concatenate([qto, dto])})
    return out[(out["n"] > 0) | (out["to"] != out["id"])]


def near_vectors(vectors: DataFrame, threshold: float = 0.9, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """-> id, n_links, component_id, kept: one row per row of ``vectors``.

    Two vectors link when they have equal lengths and their cosine in double precision is
    at least ``threshold``; ``n_links`` is symmetric. Vectors that are null, empty or
    zero, or that hold null or non-finite components link with nothing. Rows that repeat
    an id are one vector if the vectors are equal; else they share the id's links. A
    null id links with nothing and is not kept. An empty table gives an empty table.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    v = F.col("vector")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    usable = given.filter(F.col("id").isNotNull() & fine)
    classes = cut(usable.groupBy("vector").agg(F.min("id").alias("id"), F.countDistinct("id").alias("copies")))
    # lengths with enough rows for two lists
    many = classes.groupBy(F.size("vector").alias("dim")).count().filter(F.col("count") >= 2 * s.per_list).orderBy("dim").collect()
    indexes: dict[int, Index] = {}
    lists = 0
    for r in many:
        wanted = int(np.clip(r["count"] // s.per_list, 1, s.most_lists))
        sampled = min_rounds(classes.filter(F.size("vector") == r["dim"]).select("id", "vector"), "id", min(max(s.sample, 24 * wanted), 65_536)).toPandas()
        x = units(sampled["vector"])
        apart = max(1, len(x) // 4)  # a quarter of the sample is not fitted on: the probes are measured on it
        index = fit(x[apart:] if len(x) > 1 else x, r["count"], s)
        index.first, index.probes = lists, enough_probes(index, x[:apart], threshold, s)
        indexes[r["dim"]], lists = index, lists + len(index.centres)
    sent = spark.sparkContext.broadcast(indexes)  # at most most_lists * dim and 256 * dim numbers for each length

    def place(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["vector"].map(len)):
                out = part[["id", "copies", "vector"]].copy()
                if index := sent.value.get(dim):
                    x = units(part["vector"])
                    home = index.home(x)
                    codes, missed = index.encode(x, home)
                    out["home"], out["codes"], out["missed"], out["apart"] = (home + index.first).astype(np.int32), [c.tobytes() for c in codes], missed, index.apart(x, home)
                else:
                    out["home"], out["codes"], out["missed"], out["apart"] = np.int32(-dim), b"", 0.0, 0.0
                yield out

    placed = cut(classes.mapInPandas(place, f"id long, copies long, vector {kind}, home int, codes binary, missed double, apart double"))
    least, most = np.full(lists, np.inf), np.full(lists, -np.inf)  # a list without vectors is not probed
    for r in placed.filter("home >= 0").groupBy("home").agg(F.min("apart").alias("least"), F.max("apart").alias("most")).collect():  # a row a list
        least[r["home"]], most[r["home"]] = r["least"], r["most"]

    def probe(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                for dim, part in (rows := pdf.iloc[at : at + 512]).groupby(rows["vector"].map(len)):
                    part = part.copy()
                    if index := sent.value.get(dim):
                        own = slice(index.first, index.first + len(index.centres))
                        reached = index.reached(units(part["vector"]), part["home"].to_numpy() - index.first, least[own], most[own], threshold)
                        part["lists"] = [(np.flatnonzero(r) + index.first).astype(np.int32) for r in reached]
                    else:
                        part["lists"] = [np.array([-dim], np.int32)] * len(part)
                    yield part

    placed = cut(placed.drop("apart").mapInPandas(probe, f"id long, copies long, vector {kind}, home int, codes binary, missed double, lists array<int>"))
    probing = placed.select("id", "copies", "vector", "home", F.explode("lists").alias("list"))
    # one row per list: into how many blocks its rows and into how many chunks its queries go
    held = placed.groupBy(F.col("home").alias("list")).agg(F.ceil(F.count("*") / s.block).alias("blocks"))
    asked = placed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / s.block).alias("chunks"))
    plan = cut(held.join(asked, "list"))
    salt = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    data = placed.withColumn("list", F.col("home")).join(plan, "list").withColumn("block", salt("blocks", 1)).withColumn("chunk", F.explode(F.expr("sequence(0, int(chunks) - 1)"))).select("list", "block", "chunk", "id", "copies", "vector", "codes", "missed", "lists")
    queries = probing.join(plan, "list").withColumn("chunk", salt("chunks", 2)).withColumn("block", F.explode(F.expr("sequence(0, int(blocks) - 1)"))).select(*[F.col(c).alias(f"q_{c}") for c in ("list", "block", "chunk", "id", "copies", "home", "vector")])

    def links(key, left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "n": [], "to": []})
        index = sent.value.get(len(left["vector"].iloc[0])) if key[0] >= 0 else None
        return compare(left, right, index, int(key[0]), threshold)

    keys = ["list", "block", "chunk"]
    found = cut(data.groupBy(*keys).cogroup(queries.groupBy(*[f"q_{k}" for k in keys])).applyInPandas(links, "id long, n long, to long"))
    counted = found.groupBy("id").agg(F.sum("n").alias("others"))
    parts = connected_components(found.filter("id != to"), "id", "to").withColumnRenamed("v", "id")
    of_class = classes.join(counted, "id", "left").join(parts, "id", "left").select(
        F.col("vector").alias("v"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    member = usable.join(of_class, usable["vector"] == of_class["v"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return given.select("id").join(member, "id", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )
