"""Hand-computed cases, batch against stream, hostile rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citygrid.operators import OPERATORS, rings, sources, streams, texts  # noqa: F401
from citygrid.operators.palette import merge_slots
from citygrid.operators.terrain import terrain_tile_cover
from citygrid.streams import drained


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def sql(spark, name, **frames):
    return OPERATORS[name](**frames)


def test_projection_of_known_points(spark):
    """The CN Tower in UTM zone 17, and the way back."""
    from citygrid.columns import forward, inverse, meridian, zone

    at = frame(spark, [(43.642566, -79.387139), (-33.8688, 151.2093), (0.0, 3.0), (59.9, 10.7)], "lat double, lon double")
    one = "array(named_struct('lat', lat, 'lon', lon))"
    xy = at.select("lat", "lon", F.expr(zone("lon")).alias("zone"), F.expr(meridian(zone("lon"))).alias("m")).withColumn("xy", F.expr(forward(one, "m")))
    got = xy.withColumn("back", F.expr(inverse("xy", "m"))).collect()
    assert [r["zone"] for r in got] == [17, 56, 31, 32]
    assert abs(got[0]["xy"][0]["x"] - 630084) < 1 and abs(got[0]["xy"][0]["y"] - 4833438) < 1
    assert abs(got[2]["xy"][0]["x"] - 500000) < 1e-6 and abs(got[2]["xy"][0]["y"]) < 1e-6
    for r in got:
        assert abs(r["back"][0]["lat"] - r["lat"]) < 1e-10 and abs(r["back"][0]["lon"] - r["lon"]) < 1e-10


def test_requests_and_tiles(spark):
    rows = [(1, 41.88, -87.63, 900.0, 0.0, "chicago"), (2, 41.88, -87.63, 900.0, 45.0, None), (3, 0.0, 179.999, 3000.0, 0.0, None)]
    given = frame(spark, rows, "scene_id long, lat double, lon double, radius_m double, rotation_deg double, preset_id string")
    got = {r["scene_id"]: r for r in sources.scene_requests(given).collect()}
    import hashlib

    text = json.dumps({"lat": 41.88, "lon": -87.63, "preset_id": None, "radius_m": 900.0, "rotation_deg": 45.0}, sort_keys=True, separators=(",", ":"))
    assert got[2]["request_key"] == hashlib.sha256(text.encode()).hexdigest()
    half = 900 * 1.15 / 111_320
    assert abs(got[1]["north"] - got[1]["south"] - 2 * half) < 3e-2 * half and got[1]["west"] < -87.63 < got[1]["east"]
    assert (got[2]["north"] - got[2]["south"]) / (got[1]["north"] - got[1]["south"]) == pytest.approx(math.sqrt(2), rel=0.02)
    tiles = {}
    for r in terrain_tile_cover(given).collect():
        tiles.setdefault(r["scene_id"], []).append((r["zoom"], r["x"], r["y"]))
    zoom, x, _ = tiles[1][0]
    assert zoom == 13 and abs(x - (-87.63 + 180) / 360 * 2**zoom) < 2
    assert {t[1] for t in tiles[3]} >= {0, 2 ** tiles[3][0][0] - 1}  # wrapped at the date line


def test_responses(spark):
    way = {"type": "way", "id": 7, "tags": {"building": "yes"}, "geometry": [{"lat": 1.0, "lon": 2.0}, None, {"lat": 1.0, "lon": None}, {"lat": 1.5, "lon": 2.0}]}
    relation = {"type": "relation", "id": 9, "tags": {"building": "yes"}, "members": [{"type": "way", "ref": 7, "role": "", "geometry": [{"lat": 1, "lon": 2}, {"lat": 1, "lon": 3}]}, {"type": "way", "ref": 8, "role": "inner", "geometry": []}]}
    way8 = way | {"id": 8}
    bodies = [json.dumps({"elements": [way, relation, way8]}), "<html>", "{", "", None, json.dumps({"remark": "x"}), json.dumps({"elements": [], "remark": "x"}), json.dumps({"elements": [way], "remark": "Runtime Error: out"}), json.dumps({"elements": []})]
    given = frame(spark, [(1, k, b) for k, b in enumerate(bodies)], "scene_id long, response_id long, body string")
    verdicts = {r["response_id"]: r["reason"] for r in sources.split_bad_responses(given).collect()}
    assert verdicts == {0: None, 1: "not json", 2: "not json", 3: "not json", 4: "not json", 5: "no elements", 6: "remark without data", 7: "runtime error", 8: None}
    got = {r["osm_id"]: r for r in sources.osm_elements(given).collect()}
    assert set(got) == {"w7", "r9", "w8"} and got["w7"]["n_points"] == 2 and got["r9"]["n_members"] == 2
    assert [r["osm_id"] for r in sources.suppress_outer_ways(given).collect()] == ["w8"]


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_rings(spark):
    rows = [
        (1, ring((0, 0), (4, 0), (4, 4), (0, 4)), []), (2, ring((0, 4), (4, 4), (4, 0), (0, 0), (0, 4)), []), (3, ring((0, 0), (2, 0.1), (4, 0), (4, 4), (0, 4)), []),
        (4, ring((0, 0), (1, 1)), []), (5, ring((0, 0), (1, 1), (2, 2), (0, 0)), []), (6, [], []), (7, None, None), (8, ring((0, 0), (0.5, 0), (0.5, 0.5), (0, 0.5)), []),
    ]
    given = frame(spark, rows, f"ord long, ring {rings.RING}, holes array<{rings.RING}>")
    got = {r["ord"]: r for r in rings.clean_rings(given).collect()}
    assert [got[k]["verdict"] for k in range(1, 9)] == ["kept", "kept", "kept", "too few points", "no area", "too few points", "too few points", "too small"]
    assert [(p["x"], p["y"]) for p in got[2]["ring"]][:1] == [(0.0, 0.0)] and len(got[2]["ring"]) == 4
    assert len(got[3]["ring"]) == 4  # the point 0.1 off is within the tolerance
    cut = given.filter("ord <= 2").select("ord", F.expr(rings.clipped("ring", 2)).alias("r")).collect()
    assert all(sorted((p["x"], p["y"]) for p in r["r"]) == [(0, 0), (0, 2), (2, 0), (2, 2)] for r in cut)
    inside = given.filter("ord = 1").select(*[F.expr(rings.holds("ring", str(x), "1.0")).alias(f"a{k}") for k, x in enumerate((1.0, 5.0, -1.0))]).first()
    assert list(inside) == [True, False, False]


def test_simplify_keeps_corners():
    line = np.array([[0, 0], [1, 0.01], [2, 0], [2, 2], [1, 2.4], [0, 2]], float)
    assert rings.simplify(line, 0.25, False).tolist() == [[0, 0], [2, 0], [2, 2], [1, 2.4], [0, 2]]
    assert rings.simplify(line[:2], 0.25, True).tolist() == line[:2].tolist()


def test_rings_from_lines():
    square = [[(0, 0), (4, 0)], [(4, 4), (4, 0)], [(0, 4), (4, 4)], [(0, 4), (0, 0)]]
    assert rings.chain(square) == [[(0, 0), (4, 0), (4, 4), (0, 4)]]
    assert rings.chain(square[:3]) == [] and rings.chain([]) == [] and rings.chain([[(1, 1)]]) == []


def test_slots_merge_to_the_nearest(spark):
    colours = ["#FFFFFF", "#FEFEFE", "#000000", "#FF0000"]
    regions = frame(spark, [(1, f"r{k}", k, k + 1, c) for k, c in enumerate(colours)] + [(2, "a", 0, 1, "#FFFFFF"), (2, "b", 1, 3, "#000000")], "design_id long, region string, nth int, slot int, color string")
    designs = frame(spark, [(1, 0), (2, 0)], "design_id long, printer_ix int")
    printers = frame(spark, [(0, 3)], "printer_ix int, slots int")
    got = {(r["design_id"], r["region"]): (r["new_slot"], r["new_color"]) for r in merge_slots(regions, designs, printers).collect()}
    assert got == {(1, "r0"): (1, "#FFFFFF"), (1, "r1"): (1, "#FFFFFF"), (1, "r2"): (2, "#000000"), (1, "r3"): (3, "#FF0000"), (2, "a"): (1, "#FFFFFF"), (2, "b"): (2, "#000000")}


def test_newer_jobs_cancel_older_ones(spark):
    """Job 10 is newer than job 9, whatever their names sort like."""
    rows = [(1, 1, "j-9", 9, 10, "running", 1.0), (2, 1, "j-10", 10, 20, "running", 2.0), (3, 1, "j-9", 9, 30, "done", 3.0), (4, 1, "j-10", 10, 40, "done", 4.0), (5, 1, "j-10", 10, 50, "running", 5.0), (6, 2, "k-1", 1, 5, "failed", 0.5), (7, 2, "k-2", 2, 9, "queued", 0.0)]
    jobs = frame(spark, rows, "event_id long, session_id long, job_id string, job_no long, ms long, status string, progress double")
    want = {("j-9", "cancelled", 1.0), ("j-10", "done", 4.0), ("k-1", "failed", 0.5), ("k-2", "queued", 0.0)}
    assert {tuple(r)[1:] for r in sql(spark, "job_status", jobs=jobs).collect()} == want


@pytest.mark.parametrize("name", ["dedupe_ttl", "request_pacing", "coalesce_history", "debounce", "job_status"])
def test_streams_with_late_events(spark, tmp_path, name):
    """Events that come up to three hours late, in later batches too, and repeated times: the last that is told is what the batch form says."""
    rng = np.random.default_rng(3)
    ms = np.sort(rng.integers(0, 300_000_000, 300) // 1000 * 1000)
    jobs = name == "job_status"
    rows = [(k, int(rng.integers(3)), ["view", "click", "error"][int(rng.integers(3))], int(t), f"j{k // 40}", k // 40 + int(rng.integers(2)), ["running", "done", "queued"][int(rng.integers(3))], float(k)) for k, t in enumerate(ms)]
    rows = [(*r[:4], f"j{r[5]}", *r[5:]) for r in rows]
    rows.sort(key=lambda r: r[3] + int(rng.integers(10_000_000)))
    for part in range(6):
        frame(spark, rows[part * 50 : part * 50 + 50], f"event_id long, {'session_id' if jobs else 'user_id'} long, event_type string, ms long, job_id string, job_no long, status string, progress double").coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    events = spark.read.parquet(*[f"{tmp_path}/in/p{k}" for k in range(6)])
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    got = getattr(streams, f"{name}_stream")(live, None, "4 hours")
    want = sql(spark, name, **{"jobs" if jobs else "clicks": events})
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_state_of_streams_stays_small(spark, tmp_path):
    """Keys that are no longer heard of leave the state when their time is over; events far too late are dropped."""
    for part in range(8):
        rows = [(1000 * part + k, 10 * part + k % 10, "view", 40_000_000 * part + 1000 * k) for k in range(40)] + ([(9999, 1, "view", 5)] if part == 7 else [])
        frame(spark, rows, "event_id long, user_id long, event_type string, ms long").coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    like = spark.read.parquet(f"{tmp_path}/in/p0")
    live = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    held = []
    rows = drained(streams.keyed(live, streams.FETCHES, "1 hour"), "update", watch=lambda p: held.append(p.stateOperators[0].numRowsTotal))
    assert streams.final(rows, "user_id").count() == 80 and rows.filter("event_id = 9999").count() == 0
    assert len(held) >= 8 and max(held[3:]) <= 2 * max(held[:3]) and held[-1] <= held[2]


def test_bad_inputs_of_tags(spark):
    from citygrid.operators.attributes import metres

    tags = ["inf", "nan", "1e308", "9" * 400, "-0", "0", "", " ", "12 parsecs", "3'4\"", "1,5", ";4", None]
    got = [r[0] for r in frame(spark, [(t,) for t in tags], "t string").selectExpr(metres("t")).collect()]
    assert all(v is None or 0 < v for v in got) and got[10] == 1.5 and abs(got[9] - 1.016) < 1e-9


TETRA = [(0, 0, 2, 1), (1, 0, 1, 3), (2, 1, 2, 3), (3, 0, 3, 2)]


def test_bodies_of_meshes_of_any_size(spark):
    """40 separate bodies beside a small mesh, a strip of 70,000 faces, vertex numbers with gaps, no faces."""
    from citygrid.operators.meshes import mesh_bodies

    corner = lambda k, v: (float(3 * k + (v == 1)), float(v == 2), float(v == 3))
    vertices = [(1, 10 * k + v, *corner(k, v)) for k in range(40) for v in range(4)] + [(2, v, *corner(0, v)) for v in range(4)]
    faces = [(1, 4 * k + f, 10 * k + a, 10 * k + b, 10 * k + c) for k in range(40) for f, a, b, c in TETRA] + [(2, f, a, b, c) for f, a, b, c in TETRA]
    schema = "mesh_id long, v long, x double, y double, z double", "mesh_id long, f long, a long, b long, c long"
    strip = spark.range(70_002).selectExpr("3 AS mesh_id", "id AS v", "CAST(id AS DOUBLE) AS x", "CAST(id % 2 AS DOUBLE) AS y", "0e0 AS z")
    strip_faces = spark.range(70_000).selectExpr("CAST(3 AS BIGINT) AS mesh_id", "id AS f", "id AS a", "id + 1 AS b", "id + 2 AS c")
    got = {r["mesh_id"]: r for r in mesh_bodies(frame(spark, vertices, schema[0]).unionByName(strip), frame(spark, faces, schema[1]).unionByName(strip_faces)).collect()}
    assert got[1]["bodies"] == 40 and got[1]["loose"] == 39 and got[1]["floating"] == 0 and got[1]["loose_mm3"] == round(39 / 6, 2)
    assert got[2]["bodies"] == 1 and got[3]["bodies"] == 1 and got[3]["debris"] == 1
    assert mesh_bodies(frame(spark, [], schema[0]), frame(spark, [], schema[1])).count() == 0


def test_components_in_batches(spark):
    """A path over many batches and keys has one name."""
    from citygrid.graph import components_nearby

    rows = [(k % 3, k, k + 1) for k in range(3000) if k % 500] + [(9, 9000, 9001), (9, 9001, 9001), (9, None, 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = dict(components_nearby(frame(spark, rows, "scene_id long, a long, b long"), ["scene_id"]).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {**{k: (k - 1) // 500 * 500 + 1 for k in range(1, 3001)}, 9000: 9000, 9001: 9000}


def test_search_by_index(spark):
    """Tokens of any length and with signs of expressions; the best hundred; no join that tries all pairs."""
    entries = frame(spark, [(1, "Road width", "How wide roads are", "Roads", "control"), (2, "Width", "of a tree", "Trees", "control"), (3, "a.b (c)", None, "x", "control"), (4, "axb", None, "x", "section"), (5, None, "width", "é", "control")] + [(100 + k, f"zebra {k}", "", "", "control") for k in range(150)], "entry long, label string, help string, grp string, kind string")
    asked = {"width": ["width"], "a.b": ["a.b"], "road w": ["road", "w"], "é": ["é"], "none": ["none"], "zebra": ["zebra"], "(c)": ["(c)"]}
    queries = frame(spark, [(q, t, len(ts)) for q, ts in asked.items() for t in ts], "query string, token string, n_tokens int")
    out = sql(spark, "text_search", entries=entries, queries=queries)
    got = {}
    for r in out.orderBy("query", "place").collect():
        got.setdefault(r["query"], []).append((r["entry"], r["score"]))
    assert got["width"] == [(2, 100), (1, 40), (5, 8)] and got["a.b"] == [(3, 60)] and got["road w"] == [(1, 60 + 40)] and got["é"] == [(5, 16)] and "none" not in got and len(got["zebra"]) == 100 and got["(c)"] == [(3, 40)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Join LeftSemi" in plan


def test_search_tells_every_hit(spark):
    """All hits of a query in their order, over starts of labels and scores; entries that share a number are told apart."""
    labels = {k: f"{'zebra' if k % 3 else 'a zebra'} {k}" for k in range(250)}
    entries = frame(spark, [(k, label, "", "", "control") for k, label in labels.items()] + [(900, "one okapi", "", "", "control"), (900, "two okapi", "", "", "control"), (901, "okapi", "", "", "control")], "entry long, label string, help string, grp string, kind string")
    queries = frame(spark, [("zebra", "zebra", 1), ("okapi", "okapi", 1)], "query string, token string, n_tokens int")
    out = sql(spark, "text_search", entries=entries, queries=queries)
    got = [(r["entry"], r["score"], r["place"]) for r in out.filter("query = 'zebra'").orderBy("place").collect()]
    score = lambda k: 60 if k % 3 else 40
    assert got == [(k, score(k), place) for place, k in enumerate(sorted(labels, key=lambda k: (-score(k), labels[k], k)), 1)]
    # as in the SQL, two hits of one number are more than the one token that must hit
    assert [(r["entry"], r["score"], r["place"]) for r in out.filter("query = 'okapi'").collect()] == [(901, 100, 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Join LeftSemi" in plan


@pytest.mark.parametrize("n,first,last", [(8, 0.5, 23.5), (257, -3.0, 30.0)])
def test_resampling_over_tiles(spark, n, first, last):
    """A plane over three by two tiles of eight pixels stays a plane, and goes on at the edge; a missing pixel drops its scene."""
    from citygrid.operators.terrain import resample_grid

    height = lambda x, y: 3 * x + 2 * y
    rows = [(s, x // 8, y // 8, x % 8, y % 8, 128, height(x, y), 0) for s in (1, 2) for x in range(24) for y in range(16) if not (s == 2 and (x, y) == (8, 8))]
    pixels = frame(spark, rows, "scene_id long, tx long, ty long, px long, py long, r long, g long, b long")
    windows = frame(spark, [(s, n, 8, 3, 2, first, last, 0.5, 15.5) for s in (1, 2, 3)], "scene_id long, n int, tile_px int, cols int, rws int, x_from double, x_to double, y_from double, y_to double")
    got = {(r["i"], r["j"]): r["z"] for r in resample_grid(pixels, windows).collect()}
    assert len(got) == n * n
    at = lambda a, b, k, side: min(side - 1, max(0, a + (b - a) * k / (n - 1) - 0.5))
    low = min(height(at(first, last, i, 24), at(0.5, 15.5, j, 16)) for i in (0, n - 1) for j in (0, n - 1))
    for i, j in [(0, 0), (n - 1, n - 1), (n // 2, n // 3), (1, n - 2)]:
        assert got[i, j] == pytest.approx(height(at(first, last, i, 24), at(0.5, 15.5, j, 16)) - low, abs=1e-3)
