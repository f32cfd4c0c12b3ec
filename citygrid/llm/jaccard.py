"""Similarity join on word shingles by parity sketches.

Every distinct shingle flips one bit of a document's sketch, so two sketches differ in
no more bits than their shingle sets differ in elements. The bits are dealt into
segments, one more than the largest difference that a linked pair of the size band
can have: in a linked pair at least one segment is equal in both (pigeonhole). A
segment is so wide (2**64 bits) that it is kept as the XOR of its set bits' numbers.
A few segments more than that (the spare ones) make a linked pair equal in more than
one, so that a set with no more empty segments than spare ones need not send these:
what all sets of a band would share says nothing. Documents that share a segment are
candidates. A pair whose sketches (1024 bits, for long sets two and more bits an
element) differ in more bits than its sets may is dropped; each pair used is verified on the exact sets, so no link is lost and none is
false.

Documents with equal sets are one class from the start. A bucket of classes that
share a segment is not expanded into pairs: each member is verified against one leader,
the one that it shares most buckets with. Buckets whose members are then still in more
than one component are compared in full by their sketches, block against block inside a
task, for a few rounds: in each a member is verified against the nearest few of other
components. In what is still open, a member with few partners that its sketch lets link
has them all verified pair by pair; members that have more of them on both sides are
compared by their sets, again block against block inside a task that returns no more
rows than it has members.

Shingles stand for themselves as 64-bit hashes, and classes are told apart by 64-bit
digests of their sets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citygrid.graph import connected_components
from citygrid.lineage import Shelf, cut
from citygrid.llm.common import GenerationalCache

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingle_set(text: str | None, words: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words`` words; of the whole
    sequence if it is shorter; none without words."""
    found = WORD.findall((text or "").encode().translate(LOWER))
    if not found:
        return np.zeros(0, U)
    h = np.fromiter(map(cache.__getitem__, found), U, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, U)
    for k in range(n):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


class Bands:
    """Size bands [low, high]; ``percent`` is the least similarity in hundredths."""

    def __init__(self, percent: int, ratio: float = 1.5):
        self.percent, self.lows = percent, [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(int(self.lows[-1] * ratio) + 1)
        if ratio < 100 / percent:
            raise ValueError("a band must reach from a size to the largest that links with it")

    def apart(self, a: int, b: int) -> int:
        """The most elements in which sets of sizes a and b that link can differ."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def of(self, size: int) -> list[tuple[int, int, int, int]]:
        """(band, segments, spare ones of them, most in which the set can differ from a larger
        one of the band) for each band in which a set of this size has its segments."""
        k = int(np.searchsorted(self.lows, size, side="right")) - 1
        bands = [k, k + 1] if size * 100 >= self.percent * self.lows[k + 1] else [k]
        least = [self.apart(self.lows[b + 1] - 1, self.lows[b + 1] - 1) + 1 for b in bands]
        apart = [self.apart(size, min(size * 100 // self.percent, self.lows[b + 1] - 1)) for b in bands]
        return [(b, n + 1 + n // 10, 1 + n // 10, d) for b, n, d in zip(bands, least, apart)]

    def segments(self, shingles: np.ndarray) -> np.ndarray:
        """Keys of the first segments of the sketch: the spare ones and one more than a set
        of this size can differ from any that it links with. The smaller of two linked sets
        has no more of them than the larger, and in both more of its own are equal than are
        spare. So one is equal and not empty unless both have more empty ones than are
        spare; only such sets send the empty ones. A set that links with equal ones alone
        has no keys."""
        size, out = len(shingles), [np.zeros(0, U)]
        for band, parts, spare, apart in self.of(size) if self.apart(size, size * 100 // self.percent) else []:
            need = apart + 1 + spare
            flips = mix(shingles + U(band * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            place = (flips >> U(32)) % U(parts)
            order = np.argsort(place, kind="stable")
            place, flips = place[order], mix(flips)[order]
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            held, parity = place[first], np.bitwise_xor.reduceat(flips, first)
            fit = held < U(need)
            held, parity = held[fit], parity[fit]
            if min(need, parts) - len(held) > spare:
                missing = np.setdiff1d(np.arange(min(need, parts), dtype=U), held)
                held, parity = np.concatenate([held, missing]), np.concatenate([parity, np.zeros(len(missing), U)])
            out.append(mix(parity + mix(held + U(band << 32))))
        return np.concatenate(out)


LONG = 1000


def parity(shingles: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` parity bits (a power of two) as longs: two differ in no more bits than their
    sets in elements. A sketch of half the bits is the XOR of its halves."""
    place = mix(shingles + U(0x5851F42D4C957F2D)) & U(bits - 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    return parity(shingles, 1024)


def long_sketch(shingles: np.ndarray) -> np.ndarray:
    """At least two bits an element for sets of more than ``LONG``, which fill 1024 bits; else none."""
    return parity(shingles, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) > LONG else np.zeros(0, np.int64)


def sketched(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """-> id, n, cls, bits, more, keys: size, digest, sketches and segments of each
    document's set. A task gives the segments of equal sets once as long as it remembers
    them, so a group of copies adds them a few times per task; rows without an id have none."""
    bands = Bands(percent)

    def run(batches):
        cache = GenerationalCache(word_hash, 250_000)
        seen = GenerationalCache(lambda d: [], 100_000)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(at, 256)
                found = [shingle_set(t, words, cache) for t in batch.column(1).slice(at, 256).to_pylist()]
                marks, keys = list(map(digest, found)), []
                for i, x, mark in zip(ids.to_pylist(), found, marks):
                    new = i is not None and not seen[mark]
                    if new:
                        seen[mark].append(True)
                    keys.append(bands.segments(x).view(np.int64) if new and len(x) else np.zeros(0, np.int64))
                sizes = pa.array(map(len, found), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(marks, pa.int64()), lists([sketch(x) for x in found]), lists([long_sketch(x) for x in found]), lists(keys)], ["id", "n", "cls", "bits", "more", "keys"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "id long, n long, cls long, bits array<long>, more array<long>, keys array<long>")


def digest(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(cls, shingles) of the classes in ``wanted`` (rep, cls); a class has several rows if
    its id has equal sets in several rows."""

    def run(batches):
        cache = GenerationalCache(word_hash, 250_000)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(t, words, cache) for t in batch.column(0).slice(at, 256).to_pylist()]
                found = pa.RecordBatch.from_arrays([batch.column(1).slice(at, 256), lists([x.view(np.int64) for x in sets])], ["cls", "shingles"])
                # of rows that repeat an id, those that have the class's set
                yield found.filter(pa.array([digest(x) == c for x, c in zip(sets, found.column(0).to_pylist())], pa.bool_()))

    given = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    return given.join(wanted.hint("merge"), "rep").select("text", "cls").mapInArrow(run, "cls long, shingles array<long>")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """-> id, n_shingles, component_id: one row per row of ``docs``.

    A document's set is its distinct shingles of ``words`` lower-cased words (A-Z only),
    the whole sequence if it has fewer, empty if it has none. Two documents link when
    100 * intersection >= ``percent`` * union; ``component_id`` is the smallest id that
    links reach. Null and empty texts link with nothing; a null id gets a null
    component. Rows that repeat an id are one node with the links of all its texts. An
    empty table gives an empty table. Very long texts have more segments and nothing
    else: no text is cut. Other columns are ignored.
    """
    shelf = Shelf(docs.sparkSession)
    made = shelf.put("made", sketched(docs, words, percent, id_col, text_col))
    usable = made.filter("n > 0 AND id IS NOT NULL")
    told = shelf.put("told", usable.groupBy("cls").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("more").alias("more")))
    members = shelf.put("members", shared(made, shelf))
    wanted = shelf.put("wanted", members.select("cls").distinct().join(told.select("cls", "rep"), "cls"))
    sets = shelf.put("sets", sets_of(docs, wanted, words, id_col, text_col))
    links: list[DataFrame] = []

    def close(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of classes those whose sketches let them link."""
        x, y = (told.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
        differ = sum((F.bit_count(F.col("bitsa")[k].bitwiseXOR(F.col("bitsb")[k])) for k in range(16)), F.lit(0))
        may = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
        return pairs.join(x, "a").join(y, "b").filter(may).select(*pairs.columns)

    def verify(name: str, pairs: DataFrame) -> None:
        """Adds to the links those of ``pairs`` whose sets link; only the sets of these are moved."""
        pairs = shelf.put(f"pairs {name}", pairs)
        x, y = (sets.join(pairs.select(F.col(c).alias("cls")).distinct().hint("merge"), "cls", "left_semi").select(F.col("cls").alias(c), F.col("shingles").alias(f"{c}s")) for c in "ab")
        common = F.size(F.array_intersect("as", "bs"))
        links.append(shelf.put(f"links {name}", pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").filter(100 * common >= percent * (F.size("as") + F.size("bs") - common)).select("a", "b").distinct()))

    held = members.withColumn("part", F.col("cls"))
    lead = held.groupBy("key").agg(F.min(F.struct(F.xxhash64("cls"), F.col("cls").alias("a"))).alias("lead")).select("key", "lead.a")
    pairs = held.join(lead, "key").filter("a != cls").groupBy("a", F.col("cls").alias("b")).agg(F.count("*").alias("times"))
    verify("0", close(pairs).groupBy("b").agg(F.max(F.struct("times", "a")).alias("p")).select("p.a", "b"))
    held = shelf.put("held0", still_open(members, linked(links)))
    for r in range(1, rounds + 1):
        if held.isEmpty():
            break
        found = in_sketch_blocks(held.join(told.drop("rep"), "cls"), percent, nearest=NEAREST).groupBy("a", "b").agg(F.min("apart").alias("apart"))
        best = found.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))).filter(F.col("nth") <= NEAREST)
        verify(str(r), best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        held = shelf.put(f"held{r}", still_open(held, linked(links)))
        shelf.drop(f"held{r - 1}")
    if not held.isEmpty():
        found = shelf.put("candidates", in_sketch_blocks(held.join(told.drop("rep"), "cls"), percent))
        verify("few", found.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        links.append(shelf.put("blocks", in_blocks(found.filter("b IS NULL").select("key", F.col("a").alias("cls")).distinct(), sets, percent)))
    shelf.drop("sets", "members", "candidates", *[f"held{r}" for r in range(rounds + 1)])
    # from classes to ids: a class links its rows, a repeated id its classes
    rep = told.select("cls", "rep")
    edges = linked(links).join(rep.select(F.col("cls").alias("a"), F.col("rep").alias("x")), "a").join(rep.select(F.col("cls").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = usable.select("id", "cls").join(rep, "cls").filter("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    parts = connected_components(edges.unionByName(equal))
    out = cut(
        made.select("id", "n").join(parts, F.col("id") == F.col("v"), "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    )
    shelf.drop("")
    return out


def linked(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def still_open(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, cls, part) of the buckets whose members are not all in one component."""
    parts = connected_components(links)
    held = members.select("key", "cls").join(parts.withColumnRenamed("v", "cls"), "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("part"))
    keys = held.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p != q").select("key")
    return held.join(keys, "key")


def hot_keys(made: DataFrame, one_in: int = 64, most: int = 1000) -> DataFrame:
    """At most ``most`` keys that many sets have, from those of one class in ``one_in``."""
    some = made.filter(F.pmod(F.xxhash64("cls"), F.lit(one_in)) == 0).select(F.explode("keys").alias("key"), "cls")
    return some.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("p"), F.max("cls").alias("q")).filter("n >= 16 AND p != q").orderBy(F.desc("n"), "key").limit(most).select("key")


def shared(made: DataFrame, shelf: Shelf) -> DataFrame:
    """(key, cls) of segments that more than one set has; buckets with the same members are one.

    A window over a key finds out whether it is shared; keys that are hot in a sample are
    known to be, and pass no window.
    """
    hot = shelf.put("hot", hot_keys(made))
    given = made.select(F.explode("keys").alias("key"), "cls").join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")  # at most 1000 keys
    of_key = Window.partitionBy("key")
    more = given.filter("hot IS NULL").select("key", "cls", F.min("cls").over(of_key).alias("p"), F.max("cls").over(of_key).alias("q")).filter("p != q")
    held = shelf.put("shared", more.select("key", "cls").unionByName(given.filter("hot").select("key", "cls")).distinct())
    told = held.groupBy("key").agg(F.count("*").alias("size"), F.min("cls").alias("least"), F.bit_xor(F.xxhash64("cls")).alias("x1"), F.bit_xor(F.xxhash64("cls", F.lit(7))).alias("x2"))
    one = told.groupBy("size", "least", "x1", "x2").agg(F.min("key").alias("key"))
    return held.join(one.select("key"), "key")


#: Members of a block that are compared by their sketches, and by their sets.
SKETCHES = 2048
SETS = 256
#: Partners that a member meets in a round.
NEAREST = 3
#: A member with up to so many partners in a block has each of them verified.
FEW = 4


def dealt(held: DataFrame, block: int) -> DataFrame:
    """The rows of each bucket once for each pair (lo, hi) of its blocks that they are in."""
    size = held.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
    rows = held.join(size, "key").withColumn("own", F.pmod(F.xxhash64("cls", "key"), F.col("n_blocks")).cast("int"))
    return rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumn("lo", F.least("own", "with")).withColumn("hi", F.greatest("own", "with")).drop("n_blocks", "with")


class Sketches:
    """Sketches of many sets, by their place: ``differ`` gives the bits in which pairs differ,
    at the length of the shorter one of each pair."""

    def __init__(self, bits: np.ndarray, more: list[np.ndarray]):
        size = np.array([len(m) or bits.shape[1] for m in more], np.int64)
        self.of, self.row, self.sizes = np.zeros(len(more), np.int64), np.zeros(len(more), np.int64), np.unique(size)
        self.held = []
        for k, n in enumerate(self.sizes):
            own = np.flatnonzero(size == n)
            self.of[own], self.row[own] = k, np.arange(len(own))
            self.held.append(np.stack([more[i] if len(more[i]) else bits[i] for i in own]).view(U))
        self.bits = bits

    def differ(self, x: np.ndarray, y: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Pairs beyond ``bound`` by the short sketches are not looked at again."""
        out = np.bitwise_count(self.bits[x] ^ self.bits[y]).sum(1, dtype=np.int64)
        if len(self.sizes) > 1 or self.sizes[0] > self.bits.shape[1]:
            again = np.flatnonzero((out <= bound) & (np.minimum(self.sizes[self.of[x]], self.sizes[self.of[y]]) > self.bits.shape[1]))
            for both in np.unique(np.stack([self.of[x[again]], self.of[y[again]]], 1), axis=0) if len(again) else ():
                part = again[(self.of[x[again]] == both[0]) & (self.of[y[again]] == both[1])]
                for at in range(0, len(part), 1024):
                    now = part[at : at + 1024]
                    sides = [self.held[k][self.row[z[now]]] for k, z in zip(both, (x, y))]
                    least = min(m.shape[1] for m in sides)
                    sides = [np.bitwise_xor.reduce(m.reshape(len(m), -1, least), 1) for m in sides]
                    out[now] = np.bitwise_count(sides[0] ^ sides[1]).sum(1, dtype=np.int64)
        return out


def near_by_sketch(group: np.ndarray, part: np.ndarray, own: np.ndarray, n: np.ndarray, sketches: Sketches, percent: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one group and different parts whose sizes and sketches let them link, and how many bits differ.

    Groups are runs; where ``whole`` is false only rows of different blocks are compared.
    """
    left, right, far = [], [], []
    at, k = np.arange(len(group)), 0
    while len(at):
        k += 1
        at = at[at + k < len(group)]
        at = at[group[at] == group[at + k]]
        x, y = at, at + k
        fit = (part[x] != part[y]) & (whole[x] | (own[x] != own[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[fit], y[fit]
        if len(x):
            bound = (n[x] + n[y]) * (100 - percent) // (100 + percent)
            differ = sketches.differ(x, y, bound)
            may = differ <= bound
            left.append(x[may])
            right.append(y[may])
            far.append(differ[may])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none), np.concatenate(far or none)


def in_sketch_blocks(held: DataFrame, percent: int, nearest: int = 0) -> DataFrame:
    """(key, cls, part, n, bits, more) -> candidates (key, a, b, apart): pairs across parts whose
    sketches let them link, and the bits in which these differ.

    With ``nearest`` each member comes with so many of its nearest partners in a pair of
    blocks. Else each pair is there in which one of the two has at most ``FEW`` partners
    in a pair of blocks; for one in which both have more, both are there with a null b.
    """
    parts = held.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = dealt(held, SKETCHES).repartition(int(parts), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    rows = rows.select("key", "lo", "hi", "own", "cls", "part", "n", "bits", "more")

    def groups(batches) -> Iterator[pa.Table]:
        """Whole groups, over the borders of batches."""
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            last = np.stack([t.column(c).to_numpy() for c in ("key", "lo", "hi")], 1)
            begins = np.flatnonzero((last[1:] != last[:-1]).any(1)) + 1
            cut_at = int(begins[-1]) if len(begins) else 0
            if cut_at:
                yield t.slice(0, cut_at)
            rest = t.slice(cut_at)
        if rest is not None and rest.num_rows:
            yield rest

    def run(batches):
        for t in groups(batches):
            key, lo, hi, own, cls, part, n = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "own", "cls", "part", "n"))
            bits = t.column("bits").combine_chunks().flatten().to_numpy().view(U).reshape(-1, 16)
            sketches = Sketches(bits, [m.values.to_numpy() for m in t.column("more").combine_chunks()])
            marks = np.stack([key, lo, hi], 1)
            group = np.concatenate([[0], np.cumsum((marks[1:] != marks[:-1]).any(1))])
            x, y, far = near_by_sketch(group, part, own, n, sketches, percent, lo == hi)
            if nearest:
                a, b, apart = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([far, far])
                order = np.lexsort((cls[b], apart, a))
                begins = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1]])) if len(a) else order
                place = np.arange(len(a)) - np.repeat(begins, np.diff(np.append(begins, len(a))))
                first = order[place < nearest]
                out = [key[a[first]], cls[a[first]], pa.array(cls[b[first]]), apart[first]]
            else:
                times = np.bincount(np.concatenate([x, y]), minlength=len(key))
                few = np.minimum(times[x], times[y]) <= FEW
                many = np.unique(np.concatenate([x[~few], y[~few]]))
                b = pa.concat_arrays([pa.array(cls[y[few]]), pa.nulls(len(many), pa.int64())])
                out = [np.concatenate([key[x[few]], key[many]]), np.concatenate([cls[x[few]], cls[many]]), b, np.concatenate([far[few], np.zeros(len(many), np.int64)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in out], ["key", "a", "b", "apart"])

    return rows.mapInArrow(run, "key long, a long, b long, apart long")


def in_blocks(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, cls) -> links (a, b) that span the components inside each bucket.

    A task compares two blocks by products of their 0/1 matrices and returns no more rows
    than it has members.
    """

    def compare(pdf):
        pdf = pdf.sort_values("cls")
        left, right = (pdf, pdf) if pdf["lo"].iloc[0] == pdf["hi"].iloc[0] else (pdf[pdf["own"] == pdf["lo"]], pdf[pdf["own"] == pdf["hi"]])
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        common = np.zeros((len(left), len(right)), np.float32)
        sides = []
        for side in (left, right):
            n = side["shingles"].map(len).to_numpy()
            sides.append((np.concatenate(side["shingles"].to_list()), np.repeat(np.arange(len(side)), n), n))
        both = np.intersect1d(sides[0][0], sides[1][0])
        for at in range(0, len(both), 4096):
            part = both[at : at + 4096]
            ones = []
            for values, rows, n in sides:
                place = np.searchsorted(part, values).clip(max=len(part) - 1)
                hit = part[place] == values
                m = np.zeros((len(n), len(part)), np.float32)
                m[rows[hit], place[hit]] = 1
                ones.append(m)
            common += ones[0] @ ones[1].T
        common = common.astype(np.int64)
        linked = 100 * common >= percent * (sides[0][2][:, None] + sides[1][2] - common)
        x, y = left["cls"].to_numpy(), right["cls"].to_numpy()
        lx, ly, high = x.copy(), y.copy(), np.iinfo(np.int64).max
        while True:
            to_y = np.minimum(ly, np.where(linked, lx[:, None], high).min(0))
            to_x = np.minimum(lx, np.where(linked, to_y, high).min(1))
            if (to_y == ly).all() and (to_x == lx).all():
                break
            lx, ly = to_x, to_y
        out = pd.DataFrame({"a": np.concatenate([lx, ly]), "b": np.concatenate([x, y])})
        return out[out["a"] != out["b"]].drop_duplicates()

    return dealt(held, SETS).join(sets, "cls").groupBy("key", "lo", "hi").applyInPandas(compare, "a long, b long")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the component's; of rows that repeat an id, all.

    Rows with a null id stay.
    """
    ids = groups.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(ids, docs[id_col] == ids["_gone"], "left_anti")
