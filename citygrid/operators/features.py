"""Clipping of lines, and of faces into tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from citygrid.operators import operator, planned
from citygrid.operators.meshes import CORNERS, PLAIN

# lines cut to each scene's square; a line that leaves it and comes back is in pieces, those of 1 m or more stay
operator("crop_lines", "road_vertices crops", """
WITH seg AS (SELECT v.scene_id, osm_id, seq, half, x AS xa, y AS ya, lead(x) OVER (PARTITION BY v.scene_id, osm_id ORDER BY seq) AS xb, lead(y) OVER (PARTITION BY v.scene_id, osm_id ORDER BY seq) AS yb FROM {road_vertices} v JOIN {crops} k ON k.scene_id = v.scene_id),
 par AS (SELECT *, xb - xa AS dx, yb - ya AS dy FROM seg WHERE xb IS NOT NULL),
 cut AS (SELECT *, greatest(0e0, CASE WHEN dx > 0 THEN (-half - xa) / dx WHEN dx < 0 THEN (half - xa) / dx ELSE 0e0 END, CASE WHEN dy > 0 THEN (-half - ya) / dy WHEN dy < 0 THEN (half - ya) / dy ELSE 0e0 END) AS t0,
  least(1e0, CASE WHEN dx > 0 THEN (half - xa) / dx WHEN dx < 0 THEN (-half - xa) / dx ELSE 1e0 END, CASE WHEN dy > 0 THEN (half - ya) / dy WHEN dy < 0 THEN (-half - ya) / dy ELSE 1e0 END) AS t1
  FROM par WHERE NOT (dx = 0 AND abs(xa) > half) AND NOT (dy = 0 AND abs(ya) > half)),
 kept AS (SELECT *, sqrt(dx * dx + dy * dy) * (t1 - t0) AS len FROM cut WHERE t1 > t0),
 flag AS (SELECT *, CASE WHEN t0 = 0 AND lag(seq) OVER w = seq - 1 AND lag(t1) OVER w = 1 THEN 0 ELSE 1 END AS starts FROM kept WINDOW w AS (PARTITION BY scene_id, osm_id ORDER BY seq)),
 piece AS (SELECT *, sum(starts) OVER (PARTITION BY scene_id, osm_id ORDER BY seq) AS part FROM flag),
 whole AS (SELECT scene_id, osm_id, part, min(seq) AS first_seq, count(*) AS n_segments, round(sum(len), 3) AS length_m FROM piece GROUP BY scene_id, osm_id, part HAVING sum(len) >= 1),
 named AS (SELECT *, row_number() OVER (PARTITION BY scene_id, osm_id ORDER BY part) - 1 AS nth FROM whole)
SELECT scene_id, osm_id, CASE WHEN nth = 0 THEN osm_id ELSE concat(osm_id, '-', CAST(nth AS STRING)) END AS piece_id, n_segments, length_m FROM named""")  # fmt: skip


def corner(x: str, y: str, z: str) -> str:
    return f"named_struct('x', {x}, 'y', {y}, 'z', {z})"


def between(points: str, axis: str, low: str, high: str) -> str:
    """The part of a flat polygon (x, y, z points) whose ``axis`` is from ``low`` to ``high``: a fold over
    the two planes, in which each edge gives its crossing and its end if that is inside."""
    q, p = "r[i]", "r[(i + size(r) - 1) % size(r)]"
    far = lambda v: f"h.side * ({v}.{axis} - h.at)"
    cross = corner(*(f"CASE WHEN '{a}' = '{axis}' THEN h.at ELSE {p}.{a} + ({q}.{a} - {p}.{a}) * ((h.at - {p}.{axis}) / ({q}.{axis} - {p}.{axis})) END" for a in "xyz"))
    step = f"CASE WHEN {far(q)} <= 0 AND {far(p)} <= 0 THEN array({q}) WHEN {far(q)} <= 0 THEN array({cross}, {q}) WHEN {far(p)} <= 0 THEN array({cross}) ELSE filter(array({q}), z -> false) END"
    planes = f"array(named_struct('side', -1e0, 'at', {low}), named_struct('side', 1e0, 'at', {high}))"
    return f"aggregate({planes}, {points}, (r, h) -> CASE WHEN size(r) = 0 THEN r ELSE flatten(transform(sequence(0, size(r) - 1), i -> {step})) END)"


def flat_area(points: str) -> str:
    """The area of a flat polygon in space: half the length of the sum of its edges' cross products."""
    p, q = (f"named_struct('x', {points}[{k}].x - {points}[0].x, 'y', {points}[{k}].y - {points}[0].y, 'z', {points}[{k}].z - {points}[0].z)" for k in ("i", "i + 1"))
    add = "transform(array(named_struct('p', {p}, 'q', {q})), e -> named_struct('x', s.x + e.p.y * e.q.z - e.p.z * e.q.y, 'y', s.y + e.p.z * e.q.x - e.p.x * e.q.z, 'z', s.z + e.p.x * e.q.y - e.p.y * e.q.x))[0]".replace("{p}", p).replace("{q}", q)
    return f"CASE WHEN size({points}) < 3 THEN 0e0 ELSE aggregate(sequence(1, size({points}) - 2), {corner('0e0', '0e0', '0e0')}, (s, i) -> {add}, s -> sqrt(s.x * s.x + s.y * s.y + s.z * s.z) / 2) END"


# the oracle cuts every face at the four planes of each tile in turn
def _cut(p: str, axis: str, at: str, side: int) -> str:
    q, before = f"{p}[i]", f"{p}[CASE WHEN i = 1 THEN len({p}) ELSE i - 1 END]"
    far = lambda v: f"{side} * ({v}.{axis} - {at})"
    cross = ", ".join(f"'{a}': " + (f"CAST({at} AS DOUBLE)" if a == axis else f"{before}.{a} + ({q}.{a} - {before}.{a}) * (({at} - {before}.{axis}) / ({q}.{axis} - {before}.{axis}))") for a in "xyz")
    return f"flatten(list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN {far(q)} <= 0 AND {far(before)} <= 0 THEN [{q}] WHEN {far(q)} <= 0 THEN [{{{{{cross}}}}}, {q}] WHEN {far(before)} <= 0 THEN [{{{{{cross}}}}}] ELSE [] END))"


def _turn(a: str, b: str) -> str:
    return f"pow(list_sum(list_transform(range(2, len(p4)), lambda i: (p4[i].{a} - p4[1].{a}) * (p4[i + 1].{b} - p4[1].{b}) - (p4[i].{b} - p4[1].{b}) * (p4[i + 1].{a} - p4[1].{a}))), 2)"


_DUCK = f"""
WITH face AS (SELECT b.scene_id, c.* FROM ({PLAIN}) c JOIN {{buildings}} b ON b.ord = c.mesh_id),
 grid AS (SELECT *, CASE WHEN c = 0 THEN -1e12 ELSE left_x + (right_x - left_x) * c / cols END AS xa, CASE WHEN c + 1 = cols THEN 1e12 ELSE left_x + (right_x - left_x) * (c + 1) / cols END AS xb, CASE WHEN r = 0 THEN -1e12 ELSE low_y + (high_y - low_y) * r / rws END AS ya, CASE WHEN r + 1 = rws THEN 1e12 ELSE low_y + (high_y - low_y) * (r + 1) / rws END AS yb
  FROM {{tilings}} JOIN (SELECT unnest(range(0, 8)) AS c) cc ON c < cols JOIN (SELECT unnest(range(0, 8)) AS r) rr ON r < rws),
 p0 AS (SELECT g.*, [{{{{'x': ax, 'y': ay, 'z': az}}}}, {{{{'x': bx, 'y': byy, 'z': bz}}}}, {{{{'x': cx, 'y': cy, 'z': cz}}}}] AS p0 FROM face f JOIN grid g ON g.scene_id = f.scene_id AND least(ax, bx, cx) < g.xb AND greatest(ax, bx, cx) >= g.xa AND least(ay, byy, cy) < g.yb AND greatest(ay, byy, cy) >= g.ya),
 p1 AS (SELECT *, {_cut("p0", "x", "xa", -1)} AS p1 FROM p0), p2 AS (SELECT *, {_cut("p1", "x", "xb", 1)} AS p2 FROM p1), p3 AS (SELECT *, {_cut("p2", "y", "ya", -1)} AS p3 FROM p2), p4 AS (SELECT *, {_cut("p3", "y", "yb", 1)} AS p4 FROM p3),
 part AS (SELECT *, sqrt({_turn("y", "z")} + {_turn("z", "x")} + {_turn("x", "y")}) / 2 AS area FROM p4 WHERE len(p4) > 2)
SELECT design_id, concat(substr('ABCDEFGH', c + 1, 1), CAST(rws - r AS STRING)) AS tile, count(*) AS faces, round(sum(area), 1) AS area_mm2, round(min(list_min(list_transform(p4, lambda v: v.x))), 3) AS min_x, round(max(list_max(list_transform(p4, lambda v: v.x))), 3) AS max_x, round(min(list_min(list_transform(p4, lambda v: v.y))), 3) AS min_y, round(max(list_max(list_transform(p4, lambda v: v.y))), 3) AS max_y
FROM part WHERE area > 1e-9 GROUP BY design_id, c, r, rws"""

#: The tile of a place: the outermost ones have no outer end, so no face is lost.
_of = lambda v, a, b, n: f"CAST(least({n} - 1, greatest(0, floor(({v} - {a}) / (({b} - {a}) / {n})))) AS INT)"
_end = lambda k, a, b, n, last, far: f"CASE WHEN {k} = {last} THEN {far} ELSE {a} + ({b} - {a}) * ({k}) / {n} END"
_x, _y = ("left_x", "right_x", "cols"), ("low_y", "high_y", "rws")
_SPREAD = f"""
SELECT *, explode(sequence(r0, r1)) AS r FROM (SELECT *, explode(sequence(c0, c1)) AS c FROM (
 SELECT g.*, array({corner("ax", "ay", "az")}, {corner("bx", "byy", "bz")}, {corner("cx", "cy", "cz")}) AS face, {_of("least(ax, bx, cx)", *_x)} AS c0, {_of("greatest(ax, bx, cx)", *_x)} AS c1, {_of("least(ay, byy, cy)", *_y)} AS r0, {_of("greatest(ay, byy, cy)", *_y)} AS r1
 FROM ({CORNERS}) t JOIN (SELECT scene_id, ord FROM {{buildings}}) b ON b.ord = t.mesh_id JOIN {{tilings}} g ON g.scene_id = b.scene_id) q) p"""
_ENDS = f"SELECT *, {_end('c', *_x, '0', '-1e12')} AS xa, {_end('c + 1', *_x, 'cols', '1e12')} AS xb, {_end('r', *_y, '0', '-1e12')} AS ya, {_end('r + 1', *_y, 'rws', '1e12')} AS yb FROM ({_SPREAD}) s"
# explode keeps Spark from working out a part anew wherever it is named
_PARTS = f"SELECT design_id, c, r, rws, explode(array(CASE WHEN c0 = c1 AND r0 = r1 THEN face ELSE {between(between('face', 'x', 'xa', 'xb'), 'y', 'ya', 'yb')} END)) AS part FROM ({_ENDS}) e"


@planned("tile_assign", "triangles vertices buildings tilings", _DUCK)
def tile_assign(triangles: DataFrame, vertices: DataFrame, buildings: DataFrame, tilings: DataFrame) -> DataFrame:
    """Faces cut at the planes between a design's tiles -> design_id, tile (letter from the west, number
    from the north), faces, area_mm2 and the box of what lies in it. Areas of all tiles sum to the model's.

    ``tilings`` (design_id, scene_id, cols, rws, left_x, right_x, low_y, high_y). A face is met once for
    each tile that its box touches; one within a tile is not cut. Faces without area count nowhere.
    """
    spark = triangles.sparkSession
    parts = spark.sql(_PARTS, triangles=triangles, vertices=vertices, buildings=buildings, tilings=tilings)
    ends = ", ".join(f"array_{f}(transform(part, v -> v.{a})) AS {f}_{a}" for a in "xy" for f in ("min", "max"))
    return spark.sql(
        f"""SELECT design_id, concat(substr('ABCDEFGH', c + 1, 1), CAST(rws - r AS STRING)) AS tile, count(*) AS faces, round(sum(area), 1) AS area_mm2, round(min(min_x), 3) AS min_x, round(max(max_x), 3) AS max_x, round(min(min_y), 3) AS min_y, round(max(max_y), 3) AS max_y
 FROM (SELECT design_id, c, r, rws, {ends}, explode(array({flat_area('part')})) AS area FROM {{parts}} WHERE size(part) > 2) q WHERE area > 1e-9 GROUP BY design_id, c, r, rws""", parts=parts
    )
