r"""Spelling variants: words one edit apart, found by composing automata.

The words of a partition are a minimised acceptor A: a trie whose states with equal
right languages are one state. Composed with a transducer E that makes exactly one
edit, and with the acceptor again, A . E . A accepts just the pairs one edit apart, and
these are enumerated from the partition's initial state, no pair of words being tried.

Partitions. A pair has a class L, the length of its shorter word, and one place c of
its edit, the number of code points that both words begin with. A partition is a class,
a window lo..hi of places, and the code points that all its words share outside the
window: the first ``lo`` and the last ``L - hi - 1``. So it starts in the state that the
shared beginning leads to. The windows of a class do not overlap, so each pair is
accepted in one partition only, and a word stands in as many partitions as there are
windows in its two classes: four, but for words of over 128 code points.

A partition with more than ``most`` words is halved by its window, again and again. At
a window of one place what differs is one code point, or two, so even then the
alphabet bounds it. That is exact: nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrid.lineage import Shelf

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["cls", "lo", "hi", "head", "tail"]


@dataclass(frozen=True)
class Settings:
    shortest: int = 6  # code points of a word
    least: int = 5  # occurrences of a word
    times: int = 5  # a form occurs so many times as often as its word
    slip: int = 199  # one in so many runs of a document loses a code point; 0: none
    most: int = 2000  # words of a partition that is not halved
    window: int = 64  # places of a window, at most


class Automata:
    """Minimised acceptors over one register of states, and their composition with one edit.

    A state is (accepts, ((symbol, state), ..)); equal ones are the same number, also
    between acceptors.
    """

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.arcs: list[dict[str, int]] = []
        self.accepts: list[bool] = []
        self.common: dict[tuple[int, int], list[str]] = {}
        self.swaps: dict[int, list[tuple[str, str]]] = {}
        self.grows: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def acceptor(self, words: list[str]) -> int:
        """The initial state of the minimised acceptor of ``words``, which are sorted and distinct."""
        return self._state(words, 0, len(words), 0)

    def _state(self, words: list[str], a: int, b: int, at: int) -> int:
        accepts = a < b and len(words[a]) == at
        a += accepts
        arcs = []
        while a < b:
            symbol, end = words[a][at], a + 1
            while end < b and words[end][at] == symbol:
                end += 1
            arcs.append((symbol, self._state(words, a, end, at + 1)))
            a = end
        key = (accepts, tuple(arcs))
        state = self.register.setdefault(key, len(self.arcs))
        if state == len(self.arcs):
            self.arcs.append(dict(arcs))
            self.accepts.append(accepts)
        return state

    def both(self, p: int, q: int) -> list[str]:
        """What is accepted from both states."""
        key = (p, q) if p <= q else (q, p)
        if (found := self.common.get(key)) is None:
            few, many = sorted((self.arcs[p], self.arcs[q]), key=len)
            found = [""] if self.accepts[p] and self.accepts[q] else []
            for symbol, to in few.items():
                if (other := many.get(symbol)) is not None:
                    found += [symbol + rest for rest in self.both(to, other)]
            self.common[key] = found
        return found

    def swapped(self, p: int) -> list[tuple[str, str]]:
        """Pairs accepted from ``p`` that differ by one replaced symbol, each once."""
        if (found := self.swaps.get(p)) is None:
            arcs = list(self.arcs[p].items())
            found = [(x + rest, y + rest) for i, (x, to) in enumerate(arcs) for y, other in arcs[i + 1 :] for rest in self.both(to, other)]
            for x, to in arcs:
                found += [(x + a, x + b) for a, b in self.swapped(to)]
            self.swaps[p] = found
        return found

    def grown(self, p: int, q: int, places: int) -> list[tuple[str, str]]:
        """Pairs (w, v), w accepted from ``p`` and v from ``q``, where v has one symbol more,
        put in after at most ``places - 1`` symbols and, of several such places, after the most."""
        if places < 1:
            return []
        if (found := self.grows.get((p, q))) is None:  # places left go with the length of what is accepted
            found = [(rest, y + rest) for y, to in self.arcs[q].items() for rest in self.both(p, to) if rest[:1] != y]
            for x, to in self.arcs[p].items():
                if (other := self.arcs[q].get(x)) is not None:
                    found += [(x + a, x + b) for a, b in self.grown(to, other, places - 1)]
            self.grows[p, q] = found
        return found


def near_pairs(short: list[str], long: list[str], places: int) -> list[tuple[str, str]]:
    """Pairs one edit apart of two short words, or of a short and a long one; the sorted
    short words have equal lengths, the sorted long ones one symbol more."""
    machine = Automata()
    p, q = machine.acceptor(short), machine.acceptor(long)
    return machine.swapped(p) + (machine.grown(p, q, places) if long and short else [])


def partition_summary(words: list[str], counts: list[int], cls: int, lo: int, hi: int) -> Iterator[tuple]:
    """(word, near words, largest n, its word) for the words of one partition that have near ones."""
    after = max(0, cls - hi - 1)
    middle = {w[lo : len(w) - after]: k for k, w in enumerate(words)}
    of = {n: sorted(m for m in middle if len(m) == n) for n in (cls - lo - after, cls - lo - after + 1)}
    short, long = of.values()
    near: dict[int, tuple[int, int, str]] = {}
    for a, b in near_pairs(short, long, hi - lo + 1):
        for x, y in ((middle[a], middle[b]), (middle[b], middle[a])):
            n, least, best = near.get(x, (0, 1, ""))
            near[x] = (n + 1, *min((least, best), (-counts[y], words[y])))
    for k, (n, least, best) in near.items():
        yield words[k], n, -least, best


def vocabulary(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """documents (doc_id, text) -> word, n.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased.
    Shorter runs than ``s.shortest`` can give no word, so they are not looked at.
    """
    w, h = F.col("w"), F.col("h")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(rf"[A-Za-zÀ-ÿ]{{{s.shortest},}}"), 0)).alias("w"))
    word = w
    if s.slip:
        runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), w).cast("binary")))
        gone = F.pmod(h, F.length(w)).cast("int")
        word = F.when(h % s.slip == 0, F.concat(w.substr(F.lit(1), gone), w.substr(gone + 2, F.length(w)))).otherwise(w)
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.length("word") >= s.shortest) & (F.col("n") >= s.least))


def _keyed(rows: DataFrame) -> DataFrame:
    """Head and tail: what all words of a partition share."""
    return rows.select("word", "n", "cls", "lo", "hi", F.expr("substr(word, 1, lo)").alias("head"), F.expr("right(word, greatest(0, cls - hi - 1))").alias("tail"))


def partitions(vocab: DataFrame, shelf: Shelf, s: Settings = Settings()) -> DataFrame:
    """vocab (word, n) -> a row for each word and partition that it stands in."""
    length = F.length("word")
    classes = vocab.select("word", "n", F.explode(F.array(length, length - 1)).alias("cls")).filter(F.col("cls") >= s.shortest)
    pieces = classes.withColumn("k", F.expr(f"greatest(2, int(ceil((cls + 1) / {s.window})))"))
    placed = pieces.withColumn("j", F.explode(F.expr("sequence(0, k - 1)"))).withColumns({"lo": F.expr("int(j * (cls + 1) div k)"), "hi": F.expr("int((j + 1) * (cls + 1) div k) - 1")})
    rows, done, kept = shelf.put("parts0", _keyed(placed)), 0, []
    while True:
        large = rows.groupBy(*KEY).count().filter((F.col("count") > s.most) & (F.col("lo") < F.col("hi"))).select(*KEY)
        large = shelf.put(f"large{done}", large)  # at most one in ``most`` of the rows
        if large.isEmpty():
            kept.append(rows)
            break
        kept.append(rows.join(large, KEY, "left_anti"))
        middle = F.expr("int((lo + hi + 1) div 2)")
        halves = rows.join(large, KEY, "left_semi").withColumn("half", F.explode(F.array(F.struct(F.col("lo").alias("a"), (middle - 1).alias("b")), F.struct(middle.alias("a"), F.col("hi").alias("b")))))
        done += 1
        rows = shelf.put(f"parts{done}", _keyed(halves.select("word", "n", "cls", F.col("half.a").alias("lo"), F.col("half.b").alias("hi"))))
    out = kept[0]
    for more in kept[1:]:
        out = out.select(*rows.columns).unionByName(more.select(*rows.columns))
    return out


def near_words(rows: DataFrame) -> DataFrame:
    """Rows of ``partitions`` -> word, near, best_n, best: a row for each partition in which a word has near ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, words, counts, out = None, [], [], []

        def close() -> None:
            if len(words) > 1:
                out.extend(partition_summary(words, counts, *key[:3]))

        for pdf in batches:  # sorted by partition
            for *now, word, n in zip(*(pdf[c].tolist() for c in [*KEY, "word", "n"])):
                if now != key:
                    close()
                    key, words, counts = now, [], []
                words.append(word)
                counts.append(n)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["word", "near", "best_n", "best"])
                out = []
        close()
        yield pd.DataFrame(out, columns=["word", "near", "best_n", "best"])

    return rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInPandas(run, "word string, near long, best_n long, best string")


def roots(forms: DataFrame, shelf: Shelf) -> DataFrame:
    """forms (word, form), without cycles -> word, root: the last word on the way from word to form.

    Pointers are doubled, so the rounds grow with the logarithm of the longest way; a form
    occurs several times as often as its word, so that is short anyway.
    """
    step, done = shelf.put("step0", forms.select("word", F.col("form").alias("root"))), 0
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if step.join(on, "root", "left_semi").isEmpty():
            return step
        done += 1
        step = shelf.put(f"step{done}", step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """documents (doc_id, text) -> word, form, root, n, n_near, form_n: one row per word.

    Two words are near if one inserted, deleted or replaced code point makes one of the
    other. ``form`` is the near word of largest n (ties: the smallest in code-point
    order) if that is at least ``s.times`` the word's own, else null; ``root`` follows
    forms to the last. Null and empty texts have no words; a null doc_id counts as an
    empty one; repeated rows count again; an empty table gives an empty table. Other
    columns are ignored. Words of over 128 code points stand in as many partitions as
    they have times 64, so they cost the square of their length.
    """
    shelf = Shelf(docs.sparkSession)
    vocab = shelf.put("vocab", vocabulary(docs, s))
    found = near_words(partitions(vocab, shelf, s)).select("word", F.lit(None).cast("long").alias("n"), "near", F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form")).alias("best"))
    own = vocab.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less: bigint, form: string>").alias("best"))
    told = own.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    fits = F.expr(f"-best.less >= {s.times} * n")
    told = shelf.put("told", told.select("word", "n", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    last = roots(told.filter("form IS NOT NULL").select("word", "form"), shelf)
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
