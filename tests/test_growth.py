"""What holds for tables of any size: plans without large broadcasts, rare shapes, ties."""

import contextlib
import io
import random
import re

from citygrid.catalog import QUERIES
from citygrid.operators import OPERATORS, outlines, rings, spatial

from tests.conftest import SMALL

RING = "array<struct<x:double,y:double>>"
POLYGONS = f"scene_id long, ord long, osm_id string, ring {RING}, holes array<{RING}>"


def points(ring):
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def told(df):
    """The plan; the tables here are so small that Spark broadcasts what it may."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def square(scene, k, x, y, w, d):
    return (scene, k, f"w{k}", points([(x, y), (x + w, y), (x + w, y + d), (x, y + d)]), [])


def test_crop_leaves_nothing(spark):
    """A footprint whose box meets the square, but which has nothing in it, is an empty ring after the cut."""
    ell = (1, 2, "w2", points([(-20, -20), (-5, -20), (-5, -12), (-12, -12), (-12, -5), (-20, -5)]), [])  # its notch is towards the square
    polygons = spark.createDataFrame([square(1, 1, -5, -5, 10, 10), ell, square(1, 3, 9, 0, 10, 10)], POLYGONS)
    crops = spark.createDataFrame([(1, 10.0)], "scene_id long, half double")
    out = OPERATORS["crop_polygons"](polygons=polygons, crops=crops, buildings=polygons)
    assert {r["ord"]: r["outline_m2"] for r in out.collect()} == {1: 100.0, 3: 10.0}


def test_blocks_are_merged_without_broadcast(spark):
    polygons = spark.createDataFrame([square(1, 1, 0, 0, 10, 10), square(1, 2, 12, 0, 10, 10), square(1, 3, 40, 0, 10, 10)], POLYGONS)
    near = outlines.close_pairs(polygons, 4)
    assert "BroadcastHashJoin" not in told(near) and [(r["a"], r["b"]) for r in near.collect()] == [(1, 2)]
    assert "BroadcastHashJoin" not in told(QUERIES["merge_blocks"](spark, SMALL))


def test_points_meet_areas_without_broadcast(spark):
    assert "BroadcastHashJoin" not in told(QUERIES["point_in_area"](spark, SMALL))


def test_trees_meet_buildings_without_broadcast(spark):
    assert "BroadcastHashJoin" not in told(QUERIES["select_trees"](spark, SMALL))


def test_block_heights_without_broadcast(spark):
    assert not re.search(r"BroadcastHashJoin \[(ord|block|scene_id)#", told(QUERIES["block_heights"](spark, SMALL)))


def test_audit_meets_meshes_without_broadcast(spark):
    assert not re.search(r"BroadcastHashJoin \[mesh_id#\w+\], \[ord#", told(QUERIES["printability_audit"](spark, SMALL)))


def test_fixes_meet_findings_without_broadcast(spark):
    assert not re.search(r"BroadcastHashJoin \[design_id#\w+, path#", told(QUERIES["apply_safe_fixes"](spark, SMALL)))


def test_rollup_without_broadcast(spark):
    assert not re.search(r"BroadcastHashJoin \[(ord|osm_id)#\w+\], \[(ord|osm_id|v)#", told(QUERIES["issue_rollup"](spark, SMALL)))


def test_nearest_road_in_blocks(spark):
    """Against all pairs: long and short segments, some along an axis or without length, ties, several blocks."""
    rng = random.Random(4)
    vertices = [(1, f"w{k}", n, x, y) for k in range(60) for n, (x, y) in enumerate([(rng.choice([-1500.0, 0.0, rng.uniform(-1500, 1500)]), rng.uniform(-1500, 1500)) for _ in range(3)])]
    vertices += [(1, "w70", n, float(x), 64.0) for n, x in enumerate((-900, 900, 900))] + [(1, "w71", n, float(x), 64.0) for n, x in enumerate((-800, 1024))] + [(2, "w72", 0, 0.0, 0.0), (2, "w72", 1, 0.0, 9.0)]
    vertices = spark.createDataFrame(vertices, "scene_id long, osm_id string, seq int, x double, y double")
    widths = vertices.selectExpr("osm_id", "CAST(CASE WHEN osm_id LIKE 'w7%' THEN 10 ELSE 3 + substr(osm_id, 2) % 20 END AS DOUBLE) AS width_m").distinct()
    trees = [(1, k, float(rng.randint(-1600, 1600)), float(rng.randint(-1600, 1600))) for k in range(1500)] + [(1, 2000 + k, -1000.0 + 50 * k, 64.0 + k % 9) for k in range(45)] + [(3, 3000, 0.0, 0.0), (1, 3001, None, 0.0)]
    trees = spark.createDataFrame(trees, "scene_id long, ord long, x double, y double")
    all_pairs = spatial._ROAD.replace("PAIRS", f"{{trees}} a JOIN ({spatial._SEG}) b ON a.scene_id = b.scene_id")
    want = spark.sql(all_pairs, trees=trees, road_vertices=vertices, road_widths=widths).collect()
    out = OPERATORS["nearest_road"](trees=trees, road_vertices=vertices, road_widths=widths)
    assert sorted(out.collect()) == sorted(want) and len(want) > 300
    assert "FlatMapCoGroupsInArrow" in told(out)  # no row for each cell that a segment touches


def test_rings_in_batches(spark):
    """Relations are rows of Arrow batches, no group of Python each; lines in any order of rows, without order, role or points."""
    line = lambda k, role, *ps: (1, "r1", k, role, points(ps))
    rows = [line(2, "inner", (2, 2), (2, 4), (4, 4), (2, 2)), line(1, None, (0, 10), (0, 0)), line(0, "outer", (0, 0), (10, 0), (10, 10), (0, 10)), line(None, "outer", (20, 0), (21, 0), (21, 1), (20, 1), (20, 0)), line(3, "outer", (50, 50), (51, 51)), (1, "r2", 0, "outer", None)]
    rows += [(2, f"r{k}", 0, "", points([(0, 0), (k, 0), (k, 1), (0, 1), (0, 0)])) for k in range(10, 300)]
    lines = spark.createDataFrame(rows[::-1], f"scene_id long, osm_id string, ord long, role string, points {RING}")
    out = rings.assemble_rings(lines)
    got = sorted(tuple(r) for r in out.collect())
    assert got[:2] == [(1, "r1", 0, 100.0, 2.0, 1), (1, "r1", 1, 1.0, 0.0, 0)] and sorted(got[2:]) == sorted((2, f"r{k}", 0, float(k), 0.0, 0) for k in range(10, 300))
    assert "FlatMapGroupsInPandas" not in told(out)
    assert rings.assemble_rings(lines.limit(0)).count() == 0


def test_picks_meet_objects_without_broadcast(spark):
    """Only the fixed heights of building types may be broadcast to a left join."""
    assert not re.search(r"BroadcastHashJoin \[(?!lower|highway).*LeftOuter", told(QUERIES["objects_at"](spark, SMALL)))
