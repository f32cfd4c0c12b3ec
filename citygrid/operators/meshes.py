"""Measures and tests of triangle meshes: tables of vertices and of faces, by mesh."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from citygrid.graph import union_find
from citygrid.lineage import cut
from citygrid.operators import operator, planned
from citygrid.operators.groups import reach
from citygrid.operators.outlines import measured_unions

# Faces with the coordinates of their corners. A mesh's vertices stand as one sorted array, so faces meet them in one
# join on the mesh, and what is grouped by mesh after it is not shuffled again. Vertices are mostly numbered from 0 on;
# where they are not, the array is searched
_CORNER = "CASE WHEN get(vs, CAST(t.{k} AS INT)).v = t.{k} THEN get(vs, CAST(t.{k} AS INT)) ELSE get(filter(vs, p -> p.v = t.{k}), 0) END AS p{k}"
CORNERS = f"""SELECT mesh_id, f, a, b, c, pa.x AS ax, pa.y AS ay, pa.z AS az, pb.x AS bx, pb.y AS byy, pb.z AS bz, pc.x AS cx, pc.y AS cy, pc.z AS cz FROM (
 SELECT t.mesh_id, t.f, t.a, t.b, t.c, {", ".join(_CORNER.format(k=k) for k in "abc")} FROM {{triangles}} t JOIN (SELECT mesh_id, sort_array(collect_list(struct(v, x, y, z))) AS vs FROM {{vertices}} GROUP BY mesh_id) m ON m.mesh_id = t.mesh_id) q WHERE pa IS NOT NULL AND pb IS NOT NULL AND pc IS NOT NULL"""
# in oracles, three plain joins
PLAIN = "SELECT t.mesh_id, t.f, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS byy, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM {triangles} t JOIN {vertices} p ON p.mesh_id = t.mesh_id AND p.v = t.a JOIN {vertices} q ON q.mesh_id = t.mesh_id AND q.v = t.b JOIN {vertices} r ON r.mesh_id = t.mesh_id AND r.v = t.c"
_NORMALS = "SELECT *, (byy - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (byy - ay) * (cx - ax) AS nz FROM ({corners}) corners"
NORMALS, PLAIN_NORMALS = _NORMALS.replace("{corners}", CORNERS), _NORMALS.replace("{corners}", PLAIN)


def measured(name: str, inputs: str, text: str) -> None:
    """An operator over CORNERS whose oracle is the same with plain joins."""
    operator(name, inputs, text.replace("NORMALS", f"({NORMALS})").replace("CORNERS", f"({CORNERS})"), text.replace("NORMALS", f"({PLAIN_NORMALS})").replace("CORNERS", f"({PLAIN})"))


_SIX = "(ax * (byy * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - byy * cx))"  # six times the volume under a face

measured("mesh_summary", "vertices triangles", """
SELECT q.mesh_id, n_triangles, n_vertices, volume_mm3, area_mm2, min_x, max_x, min_y, max_y, min_z, max_z, degenerate, abs(min_z) <= 1e-3 AS sits_at_zero, n_triangles <= 2000000 AS in_budget FROM (
 SELECT mesh_id, count(*) AS n_triangles, round(sum((ax - x0) * nx + (ay - y0) * ny + az * nz) / 6, 3) AS volume_mm3, round(sum(sqrt(nx * nx + ny * ny + nz * nz)) / 2, 3) AS area_mm2, min(least(ax, bx, cx)) AS min_x, max(greatest(ax, bx, cx)) AS max_x, min(least(ay, byy, cy)) AS min_y, max(greatest(ay, byy, cy)) AS max_y,
  min(least(az, bz, cz)) AS min_z, max(greatest(az, bz, cz)) AS max_z, count_if(sqrt(nx * nx + ny * ny + nz * nz) / 2 < 1e-9) AS degenerate
 FROM (SELECT n.*, min(ax) OVER (PARTITION BY mesh_id) AS x0, min(ay) OVER (PARTITION BY mesh_id) AS y0 FROM NORMALS n) m GROUP BY mesh_id) q JOIN (SELECT mesh_id, count(*) AS n_vertices FROM {vertices} GROUP BY mesh_id) v ON v.mesh_id = q.mesh_id""")  # fmt: skip

_EDGES = "SELECT mesh_id, f, a AS u, b AS v FROM {triangles} UNION ALL SELECT mesh_id, f, b, c FROM {triangles} UNION ALL SELECT mesh_id, f, c, a FROM {triangles}"


# faces that share an edge are one body; the oracle links each edge's faces to the first of them
_FACE = "f.mesh_id * 1000000 + {f}"
_LINKS = f"SELECT DISTINCT {_FACE.format(f='m.f')} AS a, {_FACE.format(f='f.f')} AS b FROM ({_EDGES}) f JOIN (SELECT mesh_id, least(u, v) AS p, greatest(u, v) AS q, min(f) AS f FROM ({_EDGES}) e1 GROUP BY mesh_id, least(u, v), greatest(u, v)) m ON m.mesh_id = f.mesh_id AND m.p = least(f.u, f.v) AND m.q = greatest(f.u, f.v) WHERE f.f > m.f"
_PLAIN_BODIES = f"SELECT f.mesh_id, coalesce(p.component, {_FACE.format(f='f.f')}) - f.mesh_id * 1000000 AS body, sum({_SIX}) / 6 AS volume, min(least(az, bz, cz)) AS low FROM ({PLAIN}) f LEFT JOIN parts p ON p.v = {_FACE.format(f='f.f')} GROUP BY f.mesh_id, coalesce(p.component, {_FACE.format(f='f.f')})"
_BODIES = """
SELECT mesh_id, count(*) AS bodies, count_if(abs(volume) < 1e-2) AS debris, count_if(nth > 1 AND abs(volume) >= 1e-2) AS loose, count_if(nth > 1 AND abs(volume) >= 1e-2 AND low > 1e-3) AS floating, round(coalesce(sum(CASE WHEN nth > 1 AND abs(volume) >= 1e-2 THEN volume END), 0e0), 2) AS loose_mm3 FROM (
 SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY abs(round(volume, 3)) DESC, body) AS nth FROM {body}) placed GROUP BY mesh_id"""


def bodies_of(mesh: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each face, sorted by mesh, the position of the first face of its body.

    Equal edges are found by sorting; of the faces along an edge each is linked to the next.
    """
    n = len(a)
    u, v, face = np.concatenate([a, b, c]), np.concatenate([b, c, a]), np.tile(np.arange(n), 3)
    keys = np.stack([np.tile(mesh, 3), np.minimum(u, v), np.maximum(u, v)])
    order = np.lexsort((face, *keys[::-1]))
    same = (keys[:, order][:, 1:] == keys[:, order][:, :-1]).all(0)
    of = np.arange(n)
    found = union_find(face[order][:-1][same].tolist(), face[order][1:][same].tolist())
    of[list(found)] = list(found.values())
    return of


def face_bodies(corners: DataFrame) -> DataFrame:
    """corners (mesh_id, f, a, b, c, ax .. cz) -> mesh_id, body (its least f), volume, low: a row for each body.

    Faces come sorted by mesh. A task takes the whole meshes of an Arrow batch at once and
    keeps the last one until its end is seen, so it holds a batch and one mesh; a mesh of a
    million faces is some 100 MB.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            ids = pdf["mesh_id"].to_numpy()
            if not len(ids):
                continue
            last = int(np.searchsorted(ids, ids[-1]))  # where the last mesh begins
            if last or held and held[0]["mesh_id"].iloc[0] != ids[0]:
                yield summed(pd.concat([*held, pdf.iloc[:last]]))
                held = []
            held.append(pdf.iloc[last:])
        if held:
            yield summed(pd.concat(held))

    def summed(m: pd.DataFrame) -> pd.DataFrame:
        p, q, r = (m[list(k)].to_numpy(float) for k in (("ax", "ay", "az"), ("bx", "byy", "bz"), ("cx", "cy", "cz")))
        mesh, f = m["mesh_id"].to_numpy(), m["f"].to_numpy()
        body, at = np.unique(bodies_of(mesh, *(m[k].to_numpy() for k in "abc")), return_inverse=True)
        low = np.full(len(body), np.inf)
        np.minimum.at(low, at, np.minimum(np.minimum(p[:, 2], q[:, 2]), r[:, 2]))
        return pd.DataFrame({"mesh_id": mesh[body], "body": f[body], "volume": np.bincount(at, (p * np.cross(q, r)).sum(1), len(body)) / 6, "low": low})

    return corners.repartition("mesh_id").sortWithinPartitions("mesh_id", "f").mapInPandas(run, "mesh_id long, body long, volume double, low double")


@planned("mesh_bodies", "vertices triangles", f"WITH RECURSIVE {reach(_LINKS)}, body AS ({_PLAIN_BODIES}), told AS ({_BODIES.replace('{body}', 'body')}) SELECT * FROM told")
def mesh_bodies(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Bodies of each mesh: how many, which are debris, loose (all but the largest) and floating."""
    spark = vertices.sparkSession
    return spark.sql(_BODIES, body=face_bodies(spark.sql(CORNERS, vertices=vertices, triangles=triangles)))


operator("edge_topology", "vertices triangles mesh_bodies", f"""
WITH edge AS (SELECT mesh_id, least(u, v) AS p, greatest(u, v) AS q, count(*) AS n, sum(CASE WHEN u < v THEN 1 ELSE -1 END) AS turn FROM ({_EDGES}) e GROUP BY mesh_id, least(u, v), greatest(u, v)),
 of_mesh AS (SELECT mesh_id, count(*) AS edges, count_if(n <> 2) AS bad, count_if(turn <> 0) AS open_edges FROM edge GROUP BY mesh_id),
 same AS (SELECT mesh_id, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT mesh_id, count(*) AS n FROM {{triangles}} GROUP BY mesh_id, least(a, b, c), a + b + c, greatest(a, b, c)) d GROUP BY mesh_id),
 v AS (SELECT mesh_id, count(*) AS vertices FROM {{vertices}} GROUP BY mesh_id), f AS (SELECT mesh_id, count(*) AS faces FROM {{triangles}} GROUP BY mesh_id)
SELECT m.mesh_id, edges, bad, open_edges, duplicates, vertices - edges + faces AS euler, b.bodies, bad = 0 AND (vertices - edges + faces) % 2 = 0 AND vertices - edges + faces <= 2 * b.bodies AS watertight
FROM of_mesh m JOIN v ON v.mesh_id = m.mesh_id JOIN f ON f.mesh_id = m.mesh_id JOIN same s ON s.mesh_id = m.mesh_id JOIN {{mesh_bodies}} b ON b.mesh_id = m.mesh_id""")  # fmt: skip

# faces that look down and lean more than 50 degrees from vertical, above the skin on the plate
measured("overhang_report", "vertices triangles", """
SELECT mesh_id, round(coalesce(sum(CASE WHEN over THEN area END), 0e0), 3) AS overhang_mm2, round(sum(area), 3) AS surface_mm2, round(coalesce(sum(CASE WHEN over THEN area END), 0e0) / sum(area), 6) AS fraction, round(coalesce(max(CASE WHEN over THEN lean END), 0e0), 3) AS steepest FROM (
 SELECT *, nz < 0 AND lean > 50 AND high > 5e-1 AS over FROM (
  SELECT mesh_id, nz, greatest(az, bz, cz) AS high, sqrt(nx * nx + ny * ny + nz * nz) / 2 AS area, degrees(asin(least(1e0, abs(nz) / sqrt(nx * nx + ny * ny + nz * nz)))) AS lean FROM NORMALS n WHERE nx <> 0 OR ny <> 0 OR nz <> 0) p) q GROUP BY mesh_id""")  # fmt: skip

# vertices equal at so many decimals become the lowest of them; faces that collapse go
DECIMALS = 2
_WELD = f"""SELECT mesh_id, v, min(v) OVER (PARTITION BY mesh_id, round(x, {DECIMALS}), round(y, {DECIMALS}), round(z, {DECIMALS})) AS kept FROM {{vertices}}"""
operator("weld_vertices", "vertices triangles", f"""
WITH w AS ({_WELD})
SELECT t.mesh_id, t.f, p.kept AS a, q.kept AS b, r.kept AS c FROM {{triangles}} t JOIN w p ON p.mesh_id = t.mesh_id AND p.v = t.a JOIN w q ON q.mesh_id = t.mesh_id AND q.v = t.b JOIN w r ON r.mesh_id = t.mesh_id AND r.v = t.c
WHERE p.kept <> q.kept AND q.kept <> r.kept AND p.kept <> r.kept""")  # fmt: skip

# what a cast to single precision does: vertices that fall together, faces without area
_CAST = "SELECT mesh_id, v, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM {vertices}"
_SINGLE = f"""
WITH single AS ({_CAST}), faces AS (SELECT mesh_id, count_if(sqrt(nx * nx + ny * ny + nz * nz) / 2 < 1e-9) AS degenerate FROM NORMALS n GROUP BY mesh_id)
SELECT v.mesh_id, n_vertices, collided, degenerate FROM (SELECT mesh_id, CAST(sum(n) AS BIGINT) AS n_vertices, CAST(sum(n - 1) AS BIGINT) AS collided FROM (SELECT mesh_id, count(*) AS n FROM single GROUP BY mesh_id, x, y, z) p GROUP BY mesh_id) v JOIN faces f ON f.mesh_id = v.mesh_id"""  # fmt: skip
operator("float32_defects", "vertices triangles", *(_SINGLE.replace("NORMALS", "(" + n.replace("{vertices}", "single") + ")") for n in (NORMALS, PLAIN_NORMALS)))

# sections at the middles of slabs of 5: a face is met once for each level between its ends. The area is Green's, each
# segment turned so that the inside is on its left
LEVEL, FIRST = 5, "5e-1"
_SEGMENTS = f"""seg AS (SELECT mesh_id, k, {FIRST} + {LEVEL} * k AS z0, nx, ny,
  CASE WHEN (az - z) * (bz - z) < 0 THEN ax + (z - az) / (bz - az) * (bx - ax) ELSE ax + (z - az) / (cz - az) * (cx - ax) END AS x1, CASE WHEN (az - z) * (bz - z) < 0 THEN ay + (z - az) / (bz - az) * (byy - ay) ELSE ay + (z - az) / (cz - az) * (cy - ay) END AS y1,
  CASE WHEN (bz - z) * (cz - z) < 0 THEN bx + (z - bz) / (cz - bz) * (cx - bx) ELSE ax + (z - az) / (cz - az) * (cx - ax) END AS x2, CASE WHEN (bz - z) * (cz - z) < 0 THEN byy + (z - bz) / (cz - bz) * (cy - byy) ELSE ay + (z - az) / (cz - az) * (cy - ay) END AS y2 FROM hit),
 near AS (SELECT *, min(x1) OVER (PARTITION BY mesh_id) AS x0, min(y1) OVER (PARTITION BY mesh_id) AS y0 FROM seg),
 cut AS (SELECT mesh_id, k, z0, count(*) AS segments, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS p, sum(((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2 * CASE WHEN (y2 - y1) * nx - (x2 - x1) * ny < 0 THEN -1 ELSE 1 END) AS a FROM near GROUP BY mesh_id, k, z0)
SELECT mesh_id, z0 AS z, segments, round(p, 3) AS perimeter_mm, round(a + 1e-7, 2) AS area_mm2, CASE WHEN p > 0 THEN round(4 * a / p + 1e-7, 2) ELSE 0e0 END AS hydraulic_mm, coalesce(lead(CASE WHEN k IS NOT NULL THEN round(a, 6) END) OVER w / nullif(round(a, 6), 0) >= 7e-1 AND lead(k) OVER w = k + 1, false) AS persists FROM cut WINDOW w AS (PARTITION BY mesh_id ORDER BY k)"""
operator("slice_profile", "vertices triangles", f"""
WITH hit AS (SELECT *, {FIRST} + {LEVEL} * k AS z FROM (SELECT *, explode(sequence(CAST(ceil((low - {FIRST}) / {LEVEL}) AS BIGINT), CAST(floor((high - {FIRST}) / {LEVEL}) AS BIGINT))) AS k FROM (SELECT *, least(az, bz, cz) AS low, greatest(az, bz, cz) AS high FROM ({NORMALS}) n) m WHERE ceil((low - {FIRST}) / {LEVEL}) <= floor((high - {FIRST}) / {LEVEL})) l WHERE {FIRST} + {LEVEL} * k > low AND {FIRST} + {LEVEL} * k < high), {_SEGMENTS}""", f"""
WITH hit AS (SELECT n.*, k, {FIRST} + {LEVEL} * k AS z FROM ({PLAIN_NORMALS}) n JOIN (SELECT CAST(unnest(range(-2, 200)) AS BIGINT) AS k) l ON {FIRST} + {LEVEL} * k > least(az, bz, cz) AND {FIRST} + {LEVEL} * k < greatest(az, bz, cz)), {_SEGMENTS}""")  # fmt: skip

# the owner of the nearest source face whose centre is within a thousandth of a shipped one
_SOURCE = "SELECT b.scene_id, t.mesh_id, t.f, (t.ax + t.bx + t.cx) / 3 AS x, (t.ay + t.byy + t.cy) / 3 AS y, (t.az + t.bz + t.cz) / 3 AS z FROM (CORNERS) t JOIN {buildings} b ON b.ord = t.mesh_id"
_APART = "((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z))"
_OWN = f"""SELECT s.scene_id, s.shipped, t.mesh_id, row_number() OVER (PARTITION BY s.scene_id, s.shipped ORDER BY round({_APART} * 1e12), t.mesh_id, t.f) AS nth FROM PAIRS WHERE {_APART} <= 1e-6"""
_OWNED = "SELECT s.scene_id, CASE WHEN o.mesh_id IS NULL THEN 'none' ELSE concat('w', CAST(o.mesh_id AS STRING)) END AS owner, count(*) AS faces FROM {shipped} s LEFT JOIN (SELECT * FROM (OWN) q WHERE nth = 1) o ON o.scene_id = s.scene_id AND o.shipped = s.shipped GROUP BY s.scene_id, CASE WHEN o.mesh_id IS NULL THEN 'none' ELSE concat('w', CAST(o.mesh_id AS STRING)) END"
_CELL = 2e-3
_near = lambda a: f"explode(sequence(CAST(floor(({a} - 1e-3) / {_CELL}) AS BIGINT), CAST(floor(({a} + 1e-3) / {_CELL}) AS BIGINT))) AS g{a}"
operator("attribute_owners", "shipped triangles vertices buildings", _OWNED.replace("OWN", _OWN.replace("PAIRS", f"""(SELECT *, CAST(floor(x / {_CELL}) AS BIGINT) AS gx, CAST(floor(y / {_CELL}) AS BIGINT) AS gy, CAST(floor(z / {_CELL}) AS BIGINT) AS gz FROM {{shipped}}) s
 JOIN (SELECT *, {_near("x")} FROM (SELECT *, {_near("y")} FROM (SELECT *, {_near("z")} FROM ({_SOURCE.replace("CORNERS", CORNERS)}) t0) t1) t2) t ON s.scene_id = t.scene_id AND s.gx = t.gx AND s.gy = t.gy AND s.gz = t.gz""")),
 _OWNED.replace("OWN", _OWN.replace("PAIRS", f"{{shipped}} s JOIN ({_SOURCE.replace("CORNERS", PLAIN)}) t ON s.scene_id = t.scene_id AND abs(s.x - t.x) <= 1e-3 AND abs(s.y - t.y) <= 1e-3")))

# a sample of each scene's faces by the hash of their number; of pairs whose boxes meet, those in which an edge of one
# passes through the other (Moller and Trumbore); pairs of one mesh that share a corner do not count
SAMPLE = 600
_SAMPLED = f"""SELECT * FROM (SELECT b.scene_id, t.mesh_id, t.f, t.ax, t.ay, t.az, t.bx, t.byy, t.bz, t.cx, t.cy, t.cz, least(t.ax, t.bx, t.cx) AS x0, greatest(t.ax, t.bx, t.cx) AS x1, least(t.ay, t.byy, t.cy) AS y0, greatest(t.ay, t.byy, t.cy) AS y1, least(t.az, t.bz, t.cz) AS z0, greatest(t.az, t.bz, t.cz) AS z1,
 row_number() OVER (PARTITION BY b.scene_id ORDER BY md5(concat(CAST(t.mesh_id AS STRING), ':', CAST(t.f AS STRING)))) AS nth FROM (CORNERS) t JOIN {{buildings}} b ON b.ord = t.mesh_id) r WHERE nth <= {SAMPLE}"""


def _passes(o: str, e: str, t: str) -> str:
    """Whether the segment from corner ``o`` of one face to corner ``e`` of it passes through the face ``t``."""
    names = {"a": ("ax", "ay", "az"), "b": ("bx", "byy", "bz"), "c": ("cx", "cy", "cz")}
    s, k = o.split(".")
    p0, p1 = [f"{s}.{c}" for c in names[k]], [f"{s}.{c}" for c in names[e]]
    d = [f"({y} - {x})" for x, y in zip(p0, p1)]
    va, vb, vc = ([f"{t}.{c}" for c in names[n]] for n in "abc")
    e1, e2, w = ([f"({y} - {x})" for x, y in zip(va, v)] for v in (vb, vc, p0))
    cross = lambda a, b: [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]
    dot = lambda a, b: "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"
    h, q = cross(d, e2), cross(w, e1)
    det = dot(e1, h)
    u, v, far = f"{dot(w, h)} / nullif({det}, 0)", f"{dot(d, q)} / nullif({det}, 0)", f"{dot(e2, q)} / nullif({det}, 0)"
    return f"coalesce(abs({det}) > 1e-9 AND {u} > 1e-9 AND {v} > 1e-9 AND {u} + {v} < 1 - 1e-9 AND {far} > 1e-9 AND {far} < 1 - 1e-9, false)"


_HIT = " OR ".join(_passes(f"{s}.{o}", e, t) for s, t in (("a", "b"), ("b", "a")) for o, e in (("a", "b"), ("b", "c"), ("c", "a")))
_TESTED = f"SELECT scene_id, count(*) AS tested, count_if(hit) AS hits FROM (SELECT a.scene_id, {_HIT} AS hit FROM PAIRS WHERE a.mesh_id < b.mesh_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.z0 < b.z1 AND b.z0 < a.z1) q GROUP BY scene_id"
_GRID = f"(SELECT *, explode(sequence(gy0, gy1)) AS gy FROM (SELECT *, explode(sequence(gx0, gx1)) AS gx FROM (SELECT *, CAST(floor(x0 / 64) AS BIGINT) AS gx0, CAST(floor(x1 / 64) AS BIGINT) AS gx1, CAST(floor(y0 / 64) AS BIGINT) AS gy0, CAST(floor(y1 / 64) AS BIGINT) AS gy1 FROM ({_SAMPLED.replace('CORNERS', CORNERS)}) s) c) d)"
operator("face_pair_intersections", "vertices triangles buildings", _TESTED.replace("PAIRS", f"{_GRID} a JOIN {_GRID} b ON a.scene_id = b.scene_id AND a.gx = b.gx AND a.gy = b.gy AND a.gx = greatest(a.gx0, b.gx0) AND a.gy = greatest(a.gy0, b.gy0)"), _TESTED.replace("PAIRS", "(SAMPLED) a JOIN (SAMPLED) b ON a.scene_id = b.scene_id".replace("SAMPLED", _SAMPLED.replace("CORNERS", PLAIN))))

# fixed values: the checks in their order, with what passes
operator("validation_report", "mesh_summary edge_topology mesh_plates", """
SELECT mesh_id, name, passed, value, threshold, min(CASE WHEN passed THEN 1 ELSE 0 END) OVER (PARTITION BY mesh_id) = 1 AS overall, coalesce(min(CASE WHEN NOT passed THEN nth END) OVER (PARTITION BY mesh_id) = nth, false) AS first_failing FROM (
 SELECT m.mesh_id, c.nth, c.name, CASE WHEN c.name = 'bounding_box' THEN p.plate_mm ELSE c.threshold END AS threshold, CASE c.name WHEN 'manifold' THEN e.bad = 0 AND e.open_edges = 0 WHEN 'watertight' THEN e.watertight WHEN 'volume' THEN m.volume_mm3 > 0 WHEN 'bounding_box' THEN m.max_x - m.min_x <= p.plate_mm AND m.max_y - m.min_y <= p.plate_mm AND m.max_z - m.min_z <= p.plate_mm WHEN 'sits_at_zero' THEN m.sits_at_zero WHEN 'triangle_budget' THEN m.in_budget WHEN 'degenerate_faces' THEN m.degenerate = 0 ELSE e.bodies = 1 END AS passed,
  CASE c.name WHEN 'manifold' THEN CAST(e.bad AS DOUBLE) WHEN 'watertight' THEN CAST(e.euler AS DOUBLE) WHEN 'volume' THEN m.volume_mm3 WHEN 'bounding_box' THEN greatest(m.max_x - m.min_x, m.max_y - m.min_y, m.max_z - m.min_z) WHEN 'sits_at_zero' THEN m.min_z WHEN 'triangle_budget' THEN CAST(m.n_triangles AS DOUBLE) WHEN 'degenerate_faces' THEN CAST(m.degenerate AS DOUBLE) ELSE CAST(e.bodies AS DOUBLE) END AS value
 FROM {mesh_summary} m JOIN {edge_topology} e ON e.mesh_id = m.mesh_id JOIN {mesh_plates} p ON p.mesh_id = m.mesh_id CROSS JOIN (VALUES (1,'manifold',0e0), (2,'watertight',2e0), (3,'volume',0e0), (4,'bounding_box',0e0), (5,'sits_at_zero',1e-3), (6,'triangle_budget',2e6), (7,'degenerate_faces',0e0), (8,'bodies',1e0)) AS c(nth, name, threshold)) q""")  # fmt: skip

# findings of a design's model on its printer: too big (shrink if that keeps three quarters, else tiles), slots beyond the
# printer's, overhangs of the scene's meshes, merged buildings, loose bodies, tiles too big; most severe first
_SCENE = """model AS (SELECT d.design_id, d.scene_id, d.plate_mm, d.nozzle_mm, d.plate_mm + CASE WHEN d.frame THEN 12 ELSE 0 END AS width, d.tiled, p.*, least(p.plate_x, p.plate_y) - 10 AS usable FROM {designs} d JOIN {printers} p ON p.printer_ix = d.printer_ix),
 fit AS (SELECT *, least(usable, 256) AS fit_plate, CAST(greatest(1, ceil(width / CAST(plate_x - 10 AS DOUBLE))) AS BIGINT) AS cols, CAST(greatest(1, ceil(width / CAST(plate_y - 10 AS DOUBLE))) AS BIGINT) AS rws FROM model),
 over AS (SELECT b.scene_id, sum(o.overhang_mm2) / sum(o.surface_mm2) AS fraction FROM {overhang_report} o JOIN {buildings} b ON b.ord = o.mesh_id GROUP BY b.scene_id),
 loose AS (SELECT b.scene_id, sum(m.loose) AS loose, sum(m.floating) AS floating FROM {mesh_bodies} m JOIN {buildings} b ON b.ord = m.mesh_id GROUP BY b.scene_id),
 merged AS (SELECT scene_id, count(*) - count(DISTINCT block) AS merged FROM {merge_blocks} GROUP BY scene_id),
 beyond AS (SELECT o.design_id, count(DISTINCT o.slot) AS n, max(o.slot) AS slot, max(f.slots) AS slots FROM {overrides} o JOIN fit f ON f.design_id = o.design_id WHERE o.slot > f.slots GROUP BY o.design_id)"""
operator("printability_audit", "designs printers overhang_report mesh_bodies merge_blocks overrides buildings", f"""
WITH {_SCENE}
SELECT *, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS severity_order FROM (
 SELECT design_id, 'exceeds-profile-plate' AS id, 'error' AS severity, CASE WHEN fit_plate >= 100 AND fit_plate / CAST(plate_mm AS DOUBLE) >= 75e-2 THEN 'plate_mm' ELSE 'tiling' END AS path, CASE WHEN fit_plate >= 100 AND fit_plate / CAST(plate_mm AS DOUBLE) >= 75e-2 THEN CAST(fit_plate AS STRING) ELSE concat(CAST(cols AS STRING), 'x', CAST(rws AS STRING)) END AS value, false AS safe FROM fit WHERE NOT tiled AND (width > plate_x + 1e-2 OR width > plate_y + 1e-2)
 UNION ALL SELECT design_id, 'slot-beyond-profile', 'error', 'colour.region_slots', CAST(slots AS STRING), true FROM beyond
 UNION ALL SELECT design_id, 'unsupported-overhang', CASE WHEN fraction >= 2e-2 THEN 'warning' ELSE 'info' END, NULL, NULL, false FROM fit JOIN over ON over.scene_id = fit.scene_id WHERE fraction >= 5e-3
 UNION ALL SELECT design_id, 'buildings-merged', 'info', NULL, CAST(merged AS STRING), false FROM fit JOIN merged ON merged.scene_id = fit.scene_id WHERE merged > 0
 UNION ALL SELECT design_id, 'floating-island', 'error', NULL, CAST(CAST(loose AS BIGINT) AS STRING), false FROM fit JOIN loose ON loose.scene_id = fit.scene_id WHERE loose > 0
 UNION ALL SELECT design_id, 'tile-exceeds-plate', 'error', 'tiling', concat(CAST(CAST(greatest(1, ceil(2 * width / CAST(plate_x - 10 AS DOUBLE))) AS BIGINT) AS STRING), 'x', CAST(CAST(greatest(1, ceil(2 * width / CAST(plate_y - 10 AS DOUBLE))) AS BIGINT) AS STRING)), false FROM fit WHERE tiled AND (width > plate_x + 1e-2 OR width > plate_y + 1e-2)) q""", merged="overhang_report mesh_bodies merge_blocks buildings")  # fmt: skip

# safe findings change the design's leaves in their order; the nozzle is never changed
_LEAVES = "SELECT design_id, 'plate_mm' AS path, CAST(plate_mm AS STRING) AS value FROM {designs} UNION ALL SELECT design_id, 'colour.region_slots', CAST(max(slot) AS STRING) FROM {overrides} GROUP BY design_id UNION ALL SELECT design_id, 'nozzle_mm', CAST(nozzle_mm AS STRING) FROM {designs}"
operator("apply_safe_fixes", "printability_audit designs overrides", f"""
SELECT l.design_id, l.path, l.value AS before, p.value AS after, p.id FROM ({_LEAVES}) l JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY design_id, path ORDER BY severity_order DESC, id DESC) AS back FROM {{printability_audit}} WHERE safe AND path IS NOT NULL AND path <> 'nozzle_mm') r WHERE back = 1) p ON p.design_id = l.design_id AND p.path = l.path WHERE l.value IS DISTINCT FROM p.value""", merged="printability_audit")  # fmt: skip

# the scene's print in filament: regions overlap, so their volumes are scaled by what the union of their plans is of the
# sum of them; seconds are four a layer, the volume at 8 mm3/s, and travel over the plan
_MINUTES = "CAST(floor(seconds / 60 + 5e-1) AS BIGINT)"
_ESTIMATE = f"""
WITH r AS (SELECT b.scene_id, s.slot, greatest(m.volume_mm3, 0) AS volume, m.min_z, m.max_z, (m.max_x - m.min_x) * (m.max_y - m.min_y) AS plan FROM {{mesh_summary}} m JOIN {{buildings}} b ON b.ord = m.mesh_id JOIN {{mesh_slots}} s ON s.mesh_id = m.mesh_id),
 t AS (SELECT r.scene_id, sum(volume) AS raw, max(u.plan_mm2) AS plan_mm2, least(1e0, max(u.plan_mm2) / sum(plan)) AS share, CAST(greatest(1, ceil((max(max_z) - min(min_z)) / 2e-1)) AS BIGINT) AS layers FROM r JOIN UNIONS u ON u.scene_id = r.scene_id GROUP BY r.scene_id),
 s AS (SELECT *, CASE WHEN raw > 0 THEN layers * 4 + raw * share * 55e-2 / 8 + layers * plan_mm2 / 40000 ELSE 0 END AS seconds FROM t)
SELECT r.scene_id, r.slot, round(sum(r.volume) * max(s.share), 1) AS volume_mm3, round(sum(r.volume) * max(s.share) * 55e-2 / 1000 * 1.24e0, 2) AS grams, round(sum(r.volume) * max(s.share) * 55e-2 / (pi() * 0.875e0 * 0.875e0) / 1000, 2) AS metres, round(max(s.plan_mm2), 1) AS plan_mm2,
 max(s.layers) AS layers, round(max(s.seconds), 1) AS seconds, max(CASE WHEN {_MINUTES} < 1 THEN 'under a minute' WHEN {_MINUTES} < 60 THEN concat(CAST({_MINUTES} AS STRING), ' min') WHEN {_MINUTES} % 60 = 0 THEN concat(CAST(CAST(floor({_MINUTES} / 60) AS BIGINT) AS STRING), ' h') ELSE concat(CAST(CAST(floor({_MINUTES} / 60) AS BIGINT) AS STRING), ' h ', CAST({_MINUTES} % 60 AS STRING), ' min') END) AS duration
FROM r JOIN s ON s.scene_id = r.scene_id GROUP BY r.scene_id, r.slot"""
# the oracle sweeps over x: in each slab the boxes that cross it are merged along y
_SWEPT = """(WITH pc AS (SELECT b.scene_id AS g, m.min_x AS x0, m.max_x AS x1, m.min_y AS y0, m.max_y AS y1 FROM {mesh_summary} m JOIN {buildings} b ON b.ord = m.mesh_id),
  slab AS (SELECT g, x, lead(x) OVER (PARTITION BY g ORDER BY x) AS xn FROM (SELECT g, x0 AS x FROM pc UNION SELECT g, x1 FROM pc) e),
  run AS (SELECT s.g, s.x, s.xn, p.y0, p.y1, max(p.y1) OVER (PARTITION BY s.g, s.x ORDER BY p.y0, p.y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM slab s JOIN pc p ON p.g = s.g AND p.x0 <= s.x AND s.xn <= p.x1)
 SELECT g AS scene_id, round(sum((xn - x) * greatest(0e0, y1 - greatest(y0, coalesce(seen, y0)))), 3) AS plan_mm2 FROM run GROUP BY g)"""


@planned("filament_estimate", "mesh_summary buildings mesh_slots", _ESTIMATE.replace("UNIONS", _SWEPT))
def filament_estimate(mesh_summary: DataFrame, buildings: DataFrame, mesh_slots: DataFrame) -> DataFrame:
    """Volume, grams and metres by slot of a scene, with its layers and time. The plan is the area of
    the union of all meshes' boxes."""
    spark = buildings.sparkSession
    summary = cut(mesh_summary)  # read twice
    at = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    box = f"array({at('min_x', 'min_y')}, {at('max_x', 'min_y')}, {at('max_x', 'max_y')}, {at('min_x', 'max_y')})"
    plans = spark.sql(f"SELECT b.scene_id, b.scene_id AS g, m.mesh_id AS ord, {box} AS ring, filter(array({box}), h -> false) AS holes FROM {{mesh_summary}} m JOIN {{buildings}} b ON b.ord = m.mesh_id", mesh_summary=summary, buildings=buildings)
    unions = measured_unions(plans).selectExpr("g AS scene_id", "outline_m2 AS plan_mm2")
    return spark.sql(_ESTIMATE.replace("UNIONS", "{unions}"), mesh_summary=summary, buildings=buildings, mesh_slots=mesh_slots, unions=unions)
