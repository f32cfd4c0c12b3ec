"""Geometry of rings: measures, clipping, cleaning, point tests, assembling.

A ring is an array of (x, y) points. Measures are folds over the array, so nothing is
exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citygrid.operators import operator, planned

RING = "array<struct<x:double,y:double>>"


def edges(ring: str, body: str) -> str:
    """The sum of ``body`` over the edges (p, q) of a ring; 0 of a ring without points."""
    p, q = f"{ring}[i]", f"{ring}[(i + 1) % size({ring})]"
    return f"aggregate(transform({ring}, (e, i) -> i), CAST(0 AS DOUBLE), (total, i) -> total + {body.replace('{p}', p).replace('{q}', q)})"


def area2(ring: str) -> str:
    """Twice the signed area: positive when counter-clockwise."""
    return edges(ring, "({p}.x * {q}.y - {q}.x * {p}.y)")


def perimeter(ring: str) -> str:
    return edges(ring, "sqrt(({q}.x - {p}.x) * ({q}.x - {p}.x) + ({q}.y - {p}.y) * ({q}.y - {p}.y))")


def over(rings: str, what) -> str:
    return f"aggregate(transform({rings}, h -> {what('h')}), CAST(0 AS DOUBLE), (a, b) -> a + b)"


# in the oracle the measures come from the shapes' own formulas
operator("footprint_metrics", "polygons buildings", f"""
SELECT scene_id, ord, osm_id, round(outline - hollow, 3) AS area_m2, round(outline, 3) AS outline_m2, round(around, 3) AS perimeter_m, round(mx / (6 * signed), 3) AS centroid_x, round(my / (6 * signed), 3) AS centroid_y,
 array_min(transform(ring, p -> p.x)) AS min_x, array_min(transform(ring, p -> p.y)) AS min_y, array_max(transform(ring, p -> p.x)) AS max_x, array_max(transform(ring, p -> p.y)) AS max_y,
 round(CASE WHEN around > 0 THEN 4 * (outline - hollow) / around ELSE 0e0 END, 6) AS width_m FROM (
 SELECT *, {area2("ring")} / 2 AS signed, abs({area2("ring")}) / 2 AS outline, {over("holes", lambda h: f"abs({area2(h)}) / 2")} AS hollow, {perimeter("ring")} + {over("holes", perimeter)} AS around,
  {edges("ring", "({p}.x + {q}.x) * ({p}.x * {q}.y - {q}.x * {p}.y)")} AS mx, {edges("ring", "({p}.y + {q}.y) * ({p}.x * {q}.y - {q}.x * {p}.y)")} AS my FROM {{polygons}}) q""", """
SELECT scene_id, ord, osm_id, round(outline - hollow, 3) AS area_m2, round(outline, 3) AS outline_m2, round(around, 3) AS perimeter_m,
 round(CASE WHEN ell THEN cx - w / 12 ELSE cx END, 3) AS centroid_x, round(CASE WHEN ell THEN cy - d / 12 ELSE cy END, 3) AS centroid_y, cx - w / 2 AS min_x, cy - d / 2 AS min_y, cx + w / 2 AS max_x, cy + d / 2 AS max_y, round(4 * (outline - hollow) / around, 6) AS width_m FROM (
 SELECT *, w * d * CASE WHEN ell THEN 75e-2 ELSE 1e0 END AS outline, CASE WHEN court THEN w * d / 4 ELSE 0e0 END AS hollow, 2 * (w + d) + CASE WHEN court THEN w + d ELSE 0e0 END AS around FROM (
  SELECT *, ord % 4 = 2 AND ord % 8 <> 4 AND ord % 16 <> 1 AS ell, ord % 4 = 3 AS court FROM {buildings}) a) b""")  # fmt: skip

operator("line_lengths", "road_vertices", """
SELECT scene_id, osm_id, count(*) AS n_vertices, round(coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0e0), 3) AS length_m FROM (
 SELECT *, lag(x) OVER (PARTITION BY scene_id, osm_id ORDER BY seq) AS px, lag(y) OVER (PARTITION BY scene_id, osm_id ORDER BY seq) AS py FROM {road_vertices}) q
GROUP BY scene_id, osm_id""")  # fmt: skip


def clipped(ring: str, half: str) -> str:
    """``ring`` cut to the square of half side ``half``: a fold over the four half-planes
    a x + b y <= c, in which each edge gives its crossing and its end if that is inside."""
    planes = ", ".join(f"named_struct('a', CAST({a} AS DOUBLE), 'b', CAST({b} AS DOUBLE), 'c', CAST({half} AS DOUBLE))" for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    far = lambda p: f"({p}.x * h.a + {p}.y * h.b - h.c)"
    q, p = "r[i]", "r[(i + size(r) - 1) % size(r)]"
    t = f"{far(p)} / ({far(p)} - {far(q)})"
    cross = f"named_struct('x', {p}.x + ({q}.x - {p}.x) * ({t}), 'y', {p}.y + ({q}.y - {p}.y) * ({t}))"
    own = f"named_struct('x', {q}.x, 'y', {q}.y)"
    step = f"CASE WHEN {far(q)} <= 0 AND {far(p)} <= 0 THEN array({own}) WHEN {far(q)} <= 0 THEN array({cross}, {own}) WHEN {far(p)} <= 0 THEN array({cross}) ELSE filter(array({own}), z -> false) END"
    return f"aggregate(array({planes}), {ring}, (r, h) -> CASE WHEN size(r) = 0 THEN r ELSE flatten(transform(sequence(0, size(r) - 1), i -> {step})) END)"


_HOLE_IN = f"abs(aggregate(h, CAST(0 AS DOUBLE), (a, p) -> a + p.x) / size(h)) <= half AND abs(aggregate(h, CAST(0 AS DOUBLE), (a, p) -> a + p.y) / size(h)) <= half"
_OUT = f"array_min(transform(ring, p -> p.x)) < half AND array_max(transform(ring, p -> p.x)) > -half AND array_min(transform(ring, p -> p.y)) < half AND array_max(transform(ring, p -> p.y)) > -half"
# footprints cut to each scene's square; parts of 1 m2 or more stay, holes when their centre stays
# an exploded ring is worked out once; as a column it would be written out again for each of its points in the filter
operator("crop_polygons", "polygons buildings crops", f"""
SELECT scene_id, ord, osm_id, round(abs({area2("ring")}) / 2, 3) AS outline_m2, size(filter(holes, h -> {_HOLE_IN})) AS n_holes,
 array_min(transform(ring, p -> p.x)) AS x0, array_min(transform(ring, p -> p.y)) AS y0, array_max(transform(ring, p -> p.x)) AS x1, array_max(transform(ring, p -> p.y)) AS y1
FROM (SELECT * EXCEPT (ring, cut), cut AS ring FROM (SELECT *, explode(array({clipped("ring", "half")})) AS cut FROM (SELECT p.*, k.half FROM {{polygons}} p JOIN {{crops}} k ON k.scene_id = p.scene_id) c WHERE {_OUT}) d) q WHERE abs({area2("ring")}) / 2 >= 1""", f"""
SELECT scene_id, ord, osm_id, round(area, 3) AS outline_m2, CASE WHEN ord % 4 = 3 AND abs(cx) <= half AND abs(cy) <= half THEN 1 ELSE 0 END AS n_holes, x0, y0,
 CASE WHEN ell AND y0 > cy THEN least(x1, cx) ELSE x1 END AS x1, CASE WHEN ell AND x0 > cx THEN least(y1, cy) ELSE y1 END AS y1 FROM (
 SELECT *, greatest(0e0, x1 - x0) * greatest(0e0, y1 - y0) - CASE WHEN ell THEN greatest(0e0, x1 - greatest(x0, cx)) * greatest(0e0, y1 - greatest(y0, cy)) ELSE 0e0 END AS area FROM (
  SELECT *, ord % 4 = 2 AS ell, greatest(cx - w / 2, -half) AS x0, greatest(cy - d / 2, -half) AS y0, least(cx + w / 2, half) AS x1, least(cy + d / 2, half) AS y1 FROM {{buildings}} f JOIN {{crops}} k USING (scene_id)) a) b WHERE area >= 1 AND x1 > x0 AND y1 > y0""")  # fmt: skip


def simplify(ring: np.ndarray, tolerance: float, closed: bool) -> np.ndarray:
    """Douglas-Peucker: the points without which the line would leave its place by more than
    ``tolerance``. A ring is cut at the point farthest from its first one."""
    if len(ring) < 3:
        return ring
    if closed:
        far = int(((ring - ring[0]) ** 2).sum(1).argmax())
        line = np.vstack([ring, ring[:1]])
        spans = [(0, far), (far, len(ring))]
    else:
        line, spans = ring, [(0, len(ring) - 1)]
    keep = {0, *(e for s in spans for e in s)}
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        p, d = line[a], line[b] - line[a]
        rest = line[a + 1 : b] - p
        length = float(np.hypot(*d))
        off = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / length if length else np.hypot(rest[:, 0], rest[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep.add(a + 1 + k)
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[sorted(k for k in keep if k < len(ring) or not closed)]


def simplified(df: DataFrame, column: str, tolerance: float, closed: bool) -> DataFrame:
    """``df`` with ``column`` simplified, one Arrow batch at a time."""

    @F.pandas_udf(RING)
    def run(rings: pd.Series) -> pd.Series:
        done = []
        for r in rings:
            points = np.array([[p["x"], p["y"]] for p in r], float).reshape(-1, 2)
            done.append([{"x": x, "y": y} for x, y in simplify(points, tolerance, closed).tolist()])
        return pd.Series(done)

    return df.withColumn(column, run(F.col(column)))


def clean_rings(polygons: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """polygons (.., ring) -> the same with ``raw_vertices``, clean ``ring`` and ``verdict``.

    Order: fewer than 3 different points or no area drop the ring; the closing point goes,
    the ring runs counter-clockwise, is simplified, snapped to 1 mm, loses points that
    repeat the one before, and drops below 1 m2. Empty and null rings have too few points.
    """
    open_ring = "CASE WHEN size(ring) > 1 AND ring[0] = ring[size(ring) - 1] THEN slice(ring, 1, size(ring) - 1) ELSE coalesce(ring, CAST(array() AS array<struct<x:double,y:double>>)) END"
    df = polygons.withColumn("raw_vertices", F.expr("greatest(size(ring), 0)")).withColumn("ring", F.expr(open_ring))
    df = df.withColumn("signed", F.expr(f"CASE WHEN size(ring) > 0 THEN {area2('ring')} / 2 ELSE 0e0 END"))
    df = df.withColumn("first_verdict", F.expr("CASE WHEN coalesce(size(ring), 0) < 3 THEN 'too few points' WHEN signed = 0 THEN 'no area' END"))
    df = df.withColumn("ring", F.expr("CASE WHEN signed < 0 THEN reverse(ring) ELSE ring END"))
    df = simplified(df, "ring", tolerance, True) if tolerance else df
    df = df.withColumn("ring", F.expr("transform(ring, p -> named_struct('x', round(p.x, 3), 'y', round(p.y, 3)))"))
    df = df.withColumn("ring", F.expr("filter(ring, (p, i) -> i = 0 OR p <> ring[i - 1])"))
    small = f"CASE WHEN first_verdict IS NOT NULL THEN first_verdict WHEN size(ring) < 3 OR abs({area2('ring')}) / 2 < 1 THEN 'too small' ELSE 'kept' END"
    return df.withColumn("verdict", F.expr(small)).drop("signed", "first_verdict")


def clean_lines(vertices: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """vertices (scene_id, osm_id, seq, x, y) -> scene_id, osm_id, raw_vertices, path, length_m, verdict."""
    lines = vertices.groupBy("scene_id", "osm_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("points"))
    lines = lines.select("scene_id", "osm_id", F.size("points").alias("raw_vertices"), F.expr("transform(points, p -> named_struct('x', p.x, 'y', p.y))").alias("path"))
    lines = simplified(lines, "path", tolerance, False) if tolerance else lines
    lines = lines.withColumn("path", F.expr("transform(path, p -> named_struct('x', round(p.x, 3), 'y', round(p.y, 3)))"))
    lines = lines.withColumn("path", F.expr("filter(path, (p, i) -> i = 0 OR p <> path[i - 1])"))
    step = "sqrt((path[i + 1].x - path[i].x) * (path[i + 1].x - path[i].x) + (path[i + 1].y - path[i].y) * (path[i + 1].y - path[i].y))"
    lines = lines.withColumn("length_m", F.expr(f"CASE WHEN size(path) > 1 THEN aggregate(sequence(0, size(path) - 2), CAST(0 AS DOUBLE), (a, i) -> a + {step}) ELSE 0e0 END"))
    return lines.withColumn("verdict", F.expr("CASE WHEN size(path) < 2 THEN 'too few points' WHEN length_m < 1 THEN 'too short' ELSE 'kept' END"))


# counts by layer and verdict; the simplify step is off here, so that SQL can say it
@planned("clean_features", "polygons road_vertices buildings", """
WITH snapped AS (SELECT scene_id, osm_id, seq, round(x, 3) AS x, round(y, 3) AS y, lag(round(x, 3)) OVER (PARTITION BY scene_id, osm_id ORDER BY seq) AS px, lag(round(y, 3)) OVER (PARTITION BY scene_id, osm_id ORDER BY seq) AS py FROM {road_vertices}),
 line AS (SELECT scene_id, osm_id, count(*) AS raw_vertices, count_if(px IS NULL OR px <> x OR py <> y) AS kept_vertices, coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0e0) AS len FROM snapped GROUP BY scene_id, osm_id),
 judged AS (SELECT scene_id, 'line' AS layer, CASE WHEN kept_vertices < 2 THEN 'too few points' WHEN len < 1 THEN 'too short' ELSE 'kept' END AS verdict, raw_vertices, kept_vertices FROM line
  UNION ALL SELECT scene_id, 'polygon', 'kept', CASE WHEN ord % 8 = 4 THEN 4 WHEN ord % 16 = 1 THEN 5 WHEN ord % 4 = 2 THEN 6 ELSE 4 END, CASE WHEN ord % 4 = 2 THEN 6 ELSE 4 END FROM {buildings})
SELECT scene_id, layer, verdict, count(*) AS n_features, CAST(sum(raw_vertices) AS BIGINT) AS vertices_before, CAST(sum(kept_vertices) AS BIGINT) AS vertices_after FROM judged GROUP BY scene_id, layer, verdict""")  # fmt: skip
def clean_features(polygons: DataFrame, road_vertices: DataFrame, buildings: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per scene and layer: features kept and dropped by reason, vertices before and after."""
    rings = clean_rings(polygons, tolerance).select("scene_id", F.lit("polygon").alias("layer"), "verdict", "raw_vertices", F.size("ring").alias("kept"))
    lines = clean_lines(road_vertices, tolerance).select("scene_id", F.lit("line").alias("layer"), "verdict", "raw_vertices", F.size("path").alias("kept"))
    return rings.unionByName(lines).groupBy("scene_id", "layer", "verdict").agg(F.count("*").alias("n_features"), F.sum("raw_vertices").alias("vertices_before"), F.sum("kept").alias("vertices_after"))


def holds(ring: str, x: str, y: str) -> str:
    """Whether a ring holds a point: an odd number of its edges cross the ray to the right."""
    p, q = f"{ring}[i]", f"{ring}[(i + 1) % size({ring})]"
    crossing = f"CASE WHEN ({p}.y > {y}) <> ({q}.y > {y}) AND {x} < ({q}.x - {p}.x) * ({y} - {p}.y) / ({q}.y - {p}.y) + {p}.x THEN 1 ELSE 0 END"
    return f"aggregate(sequence(0, size({ring}) - 1), 0, (n, i) -> n + {crossing}) % 2 = 1"


def key(p: Column) -> Column:
    """A point at 1 mm."""
    return F.concat_ws(" ", F.round(p["x"] * 1000).cast("long"), F.round(p["y"] * 1000).cast("long"))


def chain(parts: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from open lines, joined where ends are equal at 1 mm, in the order given;
    a line that finds no partner gives no ring."""
    mark = lambda p: (round(p[0] * 1000), round(p[1] * 1000))
    rings, rest = [], [list(p) for p in parts if len(p) > 1]
    while rest:
        line = rest.pop(0)
        while mark(line[0]) != mark(line[-1]):
            for k, other in enumerate(rest):
                if mark(other[0]) == mark(line[-1]) or mark(other[-1]) == mark(line[-1]):
                    line += (other if mark(other[0]) == mark(line[-1]) else other[::-1])[1:]
                    del rest[k]
                    break
            else:
                break
        if mark(line[0]) == mark(line[-1]) and len(line) > 3:
            rings.append(line[:-1])
    return rings


def _area(ring) -> float:
    x, y = np.array(ring).T
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def _holds(ring, x: float, y: float) -> bool:
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


# a relation's member lines become rings; an inner ring belongs to the outer one that holds its centre
@planned("assemble_rings", "member_lines buildings", """
SELECT scene_id, osm_id, CAST(0 AS BIGINT) AS nth, round(w * d, 3) AS outline_m2, CASE WHEN ord % 4 = 3 THEN round(w * d / 4, 3) ELSE 0e0 END AS hollow_m2, CAST(CASE WHEN ord % 4 = 3 THEN 1 ELSE 0 END AS BIGINT) AS n_holes FROM {buildings}""")
def assemble_rings(member_lines: DataFrame, buildings: DataFrame | None = None) -> DataFrame:
    """member_lines (scene_id, osm_id, ord, role, points) -> a row per outer ring.

    Chaining depends on the order inside one relation, so each relation is one row of its
    lines in their order, and rows are worked out in Arrow batches.
    Roles other than inner count as outer; lines that do not close are dropped.
    """
    at = lambda a: F.transform("points", lambda p: p[a]).alias(a)
    line = F.struct(F.col("ord").isNull().alias("last"), "ord", F.coalesce(F.col("role") == "inner", F.lit(False)).alias("inner"), at("x"), at("y"))
    relations = member_lines.groupBy("scene_id", "osm_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    relations = relations.select("scene_id", "osm_id", *[F.col(f"lines.{c}").alias(c) for c in ("inner", "x", "y")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = [], []
            for k, (kinds, xs, ys) in enumerate(zip(*(batch[c].to_pylist() for c in ("inner", "x", "y")))):
                lines = [list(zip(x or [], y or [])) for x, y in zip(xs, ys)]
                outer, holes = (chain([r for r, kind in zip(lines, kinds) if kind == inner]) for inner in (False, True))
                own: list[list[float]] = [[] for _ in outer]
                for h in holes:
                    x, y = np.mean(h, 0)
                    for o, of in zip(outer, own):
                        if _holds(o, x, y):
                            of.append(_area(h))
                            break
                rows += [k] * len(outer)
                made += [(n, round(_area(o), 3), float(round(sum(h), 3)), len(h)) for n, (o, h) in enumerate(zip(outer, own))]
            columns = zip(*made) if made else [[]] * 4
            told = [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.float64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(rows, pa.int64())) for c in ("scene_id", "osm_id")), *told], ["scene_id", "osm_id", "nth", "outline_m2", "hollow_m2", "n_holes"])

    return relations.mapInArrow(run, "scene_id long, osm_id string, nth long, outline_m2 double, hollow_m2 double, n_holes long")
