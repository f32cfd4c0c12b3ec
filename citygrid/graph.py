"""Connected components: inside Arrow batches first, then by joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrid.lineage import Shelf, cut

JUMPS = 2


def union_find(a: list, b: list) -> dict:
    """Every value of ``a`` and ``b`` -> the least one that it is linked with."""
    of: dict = {}
    for x, y in zip(a, b):
        x, y = root(of, x), root(of, y)
        if x != y:
            of[max(x, y)] = min(x, y)
    return {v: root(of, v) for v in of}


def root(of: dict, v):
    """The root of ``v``, new or known; the way to it is halved."""
    up = of.setdefault(v, v)
    while up != v:
        of[v] = of[up]
        v = of[v]
        up = of[v]
    return v


def components_nearby(edges: DataFrame, near: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """As ``connected_components``, for edges most of whose components have one value of ``near``.

    Edges are sorted by ``near``, and each Arrow batch of them, which is of bounded size, is
    joined up by itself. What is left are links between the names that a vertex has in
    several batches; if there are any, they alone go to the rounds of joins.
    """
    shelf = Shelf(edges.sparkSession)
    given = edges.select(*near, F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    kind = given.schema["a"].dataType.simpleString()

    def join_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = union_find(pdf["a"].tolist(), pdf["b"].tolist())
            yield pd.DataFrame({"v": list(found), "name": list(found.values())})

    told = shelf.put("told", given.repartition(*near).sortWithinPartitions(*near).mapInPandas(join_up, f"v {kind}, name {kind}").distinct())
    first = told.groupBy("v").agg(F.min("name").alias("name"), F.count("*").alias("n"))
    links = shelf.put("links", told.join(first.filter("n > 1").select("v", F.col("name").alias("least")).hint("merge"), "v").filter("name <> least").select(F.col("name").alias("a"), F.col("least").alias("b")).distinct())
    out = first.select("v", F.col("name").alias("component"))
    if not links.isEmpty():
        of_name = connected_components(links).select(F.col("v").alias("name"), F.col("component").alias("whole"))
        out = first.join(of_name.hint("merge"), "name", "left").select("v", F.coalesce("whole", "name").alias("component"))
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """Undirected edges -> (v, component) for every vertex of an edge.

    ``component`` is the smallest vertex that can be reached. In each round every vertex
    points to that of itself and its neighbours whose hash is least, pointers are
    followed over 2**``JUMPS`` steps, and the edges are renamed; those inside one name
    go, and the rest is a smaller graph. Hashes fall in no long row along any path, so
    the number of rounds grows with the logarithm of the longest path, also on paths
    whose vertices are in order. Nothing is collected but whether edges are left. Null
    ends are ignored. With ``rounds`` it stops after so many: parts of one component may
    then still have names of their own, but no name is in two components.
    """
    shelf = Shelf(edges.sparkSession)
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    left = shelf.put("left0", given.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names, done = None, 0
    while True:
        done += 1
        ends = left.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(left.select(F.col("b").alias("v"), F.col("a").alias("u")))
        near = ends.groupBy("v").agg(F.min(F.struct(F.xxhash64("u").alias("h"), "u")).alias("n"))
        step = shelf.put(f"near{done}", near.select("v", F.least("n", F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("u")))["u"].alias("to")))
        for _ in range(JUMPS):
            on = step.select(F.col("v").alias("to"), F.col("to").alias("next"))
            step = step.join(on, "to").select("v", F.col("next").alias("to"))
        step = shelf.put(f"step{done}", step)
        if names is None:
            names = step.select("v", F.col("to").alias("name"))
        else:
            names = names.join(step.select(F.col("v").alias("name"), "to"), "name", "left").select("v", F.coalesce("to", "name").alias("name"))
        if done != rounds:
            renamed = (
                left.join(step.select(F.col("v").alias("a"), F.col("to").alias("x")), "a")
                .join(step.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
                .filter("x != y")
                .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                .distinct()
            )
            left = shelf.put(f"left{done}", renamed)
        if done == rounds or left.isEmpty():
            least = names.groupBy("name").agg(F.min("v").alias("component"))
            out = cut(names.join(least, "name").select("v", "component"))
            shelf.drop("")
            return out
        if done % 4 == 0:  # the names so far, or their plan would grow with the rounds
            names = shelf.put(f"names{done}", names)
