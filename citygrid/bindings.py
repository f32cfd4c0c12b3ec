"""Views that turn the given tables into feature, mesh, design and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citygrid.streams import stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()

#: name -> (tables or views it reads, SQL for both engines or one for each)
BINDINGS: dict[str, tuple[str, str | tuple[str, str]]] = {
    # scenes grow with the tables: about 380 buildings, 2,500 roads and trees, 250 areas each; the last ones have fewer
    "buildings": ("part", """
SELECT CAST(floor(p_partkey / 380) AS BIGINT) AS scene_id, p_partkey AS ord, concat('w', CAST(p_partkey AS STRING)) AS osm_id,
 CAST(((p_partkey - CASE WHEN p_partkey % 6 IN (3,4) THEN p_partkey % 6 - 2 ELSE 0 END)*7919) % 1701 AS DOUBLE) - 850 + CASE p_partkey % 6 WHEN 3 THEN 14 WHEN 4 THEN 33 ELSE 0 END AS cx,
 CAST(((p_partkey - CASE WHEN p_partkey % 6 IN (3,4) THEN p_partkey % 6 - 2 ELSE 0 END)*6007) % 1709 AS DOUBLE) - 854 + CASE p_partkey % 6 WHEN 3 THEN 9 ELSE 0 END AS cy,
 CAST(5 + p_size AS DOUBLE) AS w, CAST(5 + (p_partkey*31) % 40 AS DOUBLE) AS d,
 CASE p_type WHEN 'ECONOMY' THEN 'house' WHEN 'STANDARD' THEN 'apartments' WHEN 'MEDIUM' THEN 'commercial' WHEN 'SMALL' THEN 'garage' WHEN 'LARGE' THEN 'industrial' ELSE 'yes' END AS building,
 CASE WHEN floor(p_partkey / 380) % 3 = 2 THEN NULL WHEN p_partkey % 97 = 0 THEN '590' WHEN p_partkey % 10 = 0 THEN concat(CAST(10 + p_size*3 AS STRING), ' m') WHEN p_partkey % 10 = 1 THEN concat(CAST(20 + p_size AS STRING), '''6"') WHEN p_partkey % 50 = 5 THEN '-4' WHEN p_partkey % 50 = 15 THEN 'tall' END AS height_tag,
 CASE WHEN p_partkey % 10 IN (2,3,4) THEN CAST(1 + p_size % 12 AS STRING) END AS levels_tag,
 CASE WHEN p_partkey % 20 IN (2,13) THEN CAST(1 + p_size % 6 AS STRING) END AS roof_tag,
 CASE WHEN p_partkey % 30 IN (3,11) THEN '2' END AS min_level_tag, CASE WHEN p_partkey % 40 = 10 THEN '4.5 m' END AS min_height_tag,
 CASE WHEN floor(p_partkey / 380) % 3 = 1 THEN repeat(p_name, CAST(1 + p_partkey % 90 AS INT)) WHEN p_partkey % 17 = 0 THEN p_name END AS name,
 (p_partkey % 23 = 0) AS tourism, (p_partkey % 29 = 0) AS historic, (p_partkey % 31 = 0) AS wikidata
 FROM {part}
 UNION ALL
 SELECT CAST(floor(p_partkey / 380) AS BIGINT), p_partkey + 100000000, concat('r', CAST(p_partkey AS STRING)),
 CAST(((p_partkey - CASE WHEN p_partkey % 6 IN (3,4) THEN p_partkey % 6 - 2 ELSE 0 END)*7919) % 1701 AS DOUBLE) - 850 + CASE p_partkey % 6 WHEN 3 THEN 14 WHEN 4 THEN 33 ELSE 0 END + 25e-2,
 CAST(((p_partkey - CASE WHEN p_partkey % 6 IN (3,4) THEN p_partkey % 6 - 2 ELSE 0 END)*6007) % 1709 AS DOUBLE) - 854 + CASE p_partkey % 6 WHEN 3 THEN 9 ELSE 0 END,
 CAST(5 + p_size AS DOUBLE), CAST(5 + (p_partkey*31) % 40 AS DOUBLE), 'yes', NULL, NULL, NULL, NULL, NULL, NULL, false, false, false
 FROM {part} WHERE p_partkey % 50 = 7"""),
    # footprints as rings: rectangles, L shapes and courtyards, some clockwise, some with the first point again at the end
    "polygons": ("buildings", ("""
SELECT scene_id, ord, osm_id, CASE WHEN ord % 8 = 4 THEN array(named_struct('x', cx - w / 2, 'y', cy + d / 2), named_struct('x', cx + w / 2, 'y', cy + d / 2), named_struct('x', cx + w / 2, 'y', cy - d / 2), named_struct('x', cx - w / 2, 'y', cy - d / 2)) WHEN ord % 16 = 1 THEN array(named_struct('x', cx - w / 2, 'y', cy - d / 2), named_struct('x', cx + w / 2, 'y', cy - d / 2), named_struct('x', cx + w / 2, 'y', cy + d / 2), named_struct('x', cx - w / 2, 'y', cy + d / 2), named_struct('x', cx - w / 2, 'y', cy - d / 2)) WHEN ord % 4 = 2 THEN array(named_struct('x', cx - w / 2, 'y', cy - d / 2), named_struct('x', cx + w / 2, 'y', cy - d / 2), named_struct('x', cx + w / 2, 'y', cy), named_struct('x', cx, 'y', cy), named_struct('x', cx, 'y', cy + d / 2), named_struct('x', cx - w / 2, 'y', cy + d / 2)) ELSE array(named_struct('x', cx - w / 2, 'y', cy - d / 2), named_struct('x', cx + w / 2, 'y', cy - d / 2), named_struct('x', cx + w / 2, 'y', cy + d / 2), named_struct('x', cx - w / 2, 'y', cy + d / 2)) END AS ring,
 CASE WHEN ord % 4 = 3 THEN array(array(named_struct('x', cx - w / 4, 'y', cy - d / 4), named_struct('x', cx - w / 4, 'y', cy + d / 4), named_struct('x', cx + w / 4, 'y', cy + d / 4), named_struct('x', cx + w / 4, 'y', cy - d / 4))) ELSE filter(array(array(named_struct('x', cx - w / 4, 'y', cy - d / 4), named_struct('x', cx - w / 4, 'y', cy + d / 4), named_struct('x', cx + w / 4, 'y', cy + d / 4), named_struct('x', cx + w / 4, 'y', cy - d / 4))), h -> false) END AS holes FROM {buildings}""", """
SELECT scene_id, ord, osm_id, CASE WHEN ord % 8 = 4 THEN [{{'x': cx - w / 2, 'y': cy + d / 2}}, {{'x': cx + w / 2, 'y': cy + d / 2}}, {{'x': cx + w / 2, 'y': cy - d / 2}}, {{'x': cx - w / 2, 'y': cy - d / 2}}] WHEN ord % 16 = 1 THEN [{{'x': cx - w / 2, 'y': cy - d / 2}}, {{'x': cx + w / 2, 'y': cy - d / 2}}, {{'x': cx + w / 2, 'y': cy + d / 2}}, {{'x': cx - w / 2, 'y': cy + d / 2}}, {{'x': cx - w / 2, 'y': cy - d / 2}}] WHEN ord % 4 = 2 THEN [{{'x': cx - w / 2, 'y': cy - d / 2}}, {{'x': cx + w / 2, 'y': cy - d / 2}}, {{'x': cx + w / 2, 'y': cy}}, {{'x': cx, 'y': cy}}, {{'x': cx, 'y': cy + d / 2}}, {{'x': cx - w / 2, 'y': cy + d / 2}}] ELSE [{{'x': cx - w / 2, 'y': cy - d / 2}}, {{'x': cx + w / 2, 'y': cy - d / 2}}, {{'x': cx + w / 2, 'y': cy + d / 2}}, {{'x': cx - w / 2, 'y': cy + d / 2}}] END AS ring,
 CASE WHEN ord % 4 = 3 THEN [[{{'x': cx - w / 4, 'y': cy - d / 4}}, {{'x': cx - w / 4, 'y': cy + d / 4}}, {{'x': cx + w / 4, 'y': cy + d / 4}}, {{'x': cx + w / 4, 'y': cy - d / 4}}]] ELSE [] END AS holes FROM {buildings}""")),
    # outlines of relations in open lines, the second of them backwards; never read by an oracle
    "member_lines": ("buildings", ("""
SELECT scene_id, osm_id, k AS ord, CASE WHEN k < 2 THEN CASE WHEN ord % 2 = 0 THEN 'outer' ELSE '' END ELSE 'inner' END AS role, CASE k WHEN 0 THEN array(named_struct('x', cx - w / 2, 'y', cy - d / 2), named_struct('x', cx + w / 2, 'y', cy - d / 2), named_struct('x', cx + w / 2, 'y', cy + d / 2)) WHEN 1 THEN array(named_struct('x', cx - w / 2, 'y', cy - d / 2), named_struct('x', cx - w / 2, 'y', cy + d / 2), named_struct('x', cx + w / 2, 'y', cy + d / 2)) WHEN 2 THEN array(named_struct('x', cx - w / 4, 'y', cy - d / 4), named_struct('x', cx - w / 4, 'y', cy + d / 4), named_struct('x', cx + w / 4, 'y', cy + d / 4)) ELSE array(named_struct('x', cx - w / 4, 'y', cy - d / 4), named_struct('x', cx + w / 4, 'y', cy - d / 4), named_struct('x', cx + w / 4, 'y', cy + d / 4)) END AS points
FROM {buildings} CROSS JOIN (VALUES (0),(1),(2),(3)) AS kk(k) WHERE k < 2 OR ord % 4 = 3""", "")),
    "requests": ("designs", """
SELECT scene_id, 4188e-2 + scene_id AS lat, -8763e-2 + 5 * (scene_id % 20) AS lon, max(radius_m) AS radius_m, CAST((scene_id * 37) % 360 AS DOUBLE) AS rotation_deg, CASE WHEN scene_id % 2 = 0 THEN 'chicago' END AS preset_id FROM {designs} GROUP BY scene_id"""),
    # responses of a map service as JSON: eleven a scene, of which 4, 5, 6, 7, 9 and 10 are bad; never read by an oracle
    "responses": ("buildings trees", ("""
WITH e AS (
 SELECT scene_id, ord % 6 AS c, ord AS nth, named_struct('type', 'way', 'id', ord, 'tags', map('building', building), 'geometry', CASE WHEN ord % 9 = 0 THEN transform(array(named_struct('lat', 4188e-2 + scene_id + (cy - d / 2) / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + (cx - w / 2) / 82900e0), named_struct('lat', 4188e-2 + scene_id + (cy - d / 2) / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + (cx + w / 2) / 82900e0), named_struct('lat', 4188e-2 + scene_id + (cy + d / 2) / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + (cx + w / 2) / 82900e0), named_struct('lat', 4188e-2 + scene_id + (cy + d / 2) / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + (cx - w / 2) / 82900e0), named_struct('lat', 4188e-2 + scene_id + (cy - d / 2) / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + (cx - w / 2) / 82900e0)), (p, i) -> CASE WHEN i = 2 THEN NULL ELSE p END) ELSE array(named_struct('lat', 4188e-2 + scene_id + (cy - d / 2) / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + (cx - w / 2) / 82900e0), named_struct('lat', 4188e-2 + scene_id + (cy - d / 2) / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + (cx + w / 2) / 82900e0), named_struct('lat', 4188e-2 + scene_id + (cy + d / 2) / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + (cx + w / 2) / 82900e0), named_struct('lat', 4188e-2 + scene_id + (cy + d / 2) / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + (cx - w / 2) / 82900e0), named_struct('lat', 4188e-2 + scene_id + (cy - d / 2) / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + (cx - w / 2) / 82900e0)) END, 'members', CAST(NULL AS array<struct<type:string,ref:bigint,role:string,geometry:array<struct<lat:double,lon:double>>>>), 'lat', CAST(NULL AS DOUBLE), 'lon', CAST(NULL AS DOUBLE)) AS e FROM {buildings} WHERE osm_id LIKE 'w%'
 UNION ALL SELECT scene_id, ord % 6, ord, named_struct('type', 'relation', 'id', ord - 100000000, 'tags', map('building', building), 'geometry', CAST(NULL AS array<struct<lat:double,lon:double>>), 'members', array(named_struct('type', 'way', 'ref', ord - 100000000, 'role', CASE WHEN ord % 100 = 57 THEN 'inner' WHEN ord % 200 = 7 THEN '' ELSE 'outer' END, 'geometry', array(named_struct('lat', 4188e-2 + scene_id + (cy - d / 2) / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + (cx - w / 2) / 82900e0), named_struct('lat', 4188e-2 + scene_id + (cy - d / 2) / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + (cx + w / 2) / 82900e0), named_struct('lat', 4188e-2 + scene_id + (cy + d / 2) / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + (cx + w / 2) / 82900e0), named_struct('lat', 4188e-2 + scene_id + (cy + d / 2) / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + (cx - w / 2) / 82900e0), named_struct('lat', 4188e-2 + scene_id + (cy - d / 2) / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + (cx - w / 2) / 82900e0)))), 'lat', CAST(NULL AS DOUBLE), 'lon', CAST(NULL AS DOUBLE)) FROM {buildings} WHERE osm_id LIKE 'r%'
 UNION ALL SELECT scene_id, ord % 6, ord + 1000000000, named_struct('type', 'node', 'id', ord, 'tags', map('natural', 'tree'), 'geometry', CAST(NULL AS array<struct<lat:double,lon:double>>), 'members', CAST(NULL AS array<struct<type:string,ref:bigint,role:string,geometry:array<struct<lat:double,lon:double>>>>), 'lat', 4188e-2 + scene_id + y / 111320e0, 'lon', -8763e-2 + 5 * (scene_id % 20) + x / 82900e0) FROM {trees}),
 bodies AS (SELECT scene_id, c, concat('{{"elements":[', array_join(transform(array_sort(collect_list(struct(nth, to_json(e) AS j))), x -> x.j), ','), ']}}') AS body FROM e GROUP BY scene_id, c),
 scenes AS (SELECT DISTINCT scene_id FROM {trees})
SELECT scene_id, scene_id * 16 + c AS response_id, CASE c WHEN 4 THEN replace(body, '{{"elements"', '{{"remark":"runtime error: timed out","elements"') WHEN 5 THEN substr(body, 1, length(body) - 3) ELSE body END AS body FROM bodies
UNION ALL SELECT scene_id, scene_id * 16 + c, CASE c WHEN 6 THEN '<html>busy</html>' WHEN 7 THEN '{{"elements":[],"remark":"no data"}}' WHEN 8 THEN '{{"elements":[]}}' WHEN 9 THEN '{{"version":1}}' ELSE '{{"elements":[],"remark":"Out of memory"}}' END FROM scenes CROSS JOIN (VALUES (6),(7),(8),(9),(10)) AS cc(c)""", "")),
    "road_vertices": ("lineitem", """
SELECT CAST(floor(l_orderkey / 2500) AS BIGINT) AS scene_id, concat('w', CAST(1000000 + l_orderkey AS STRING)) AS osm_id, l_linenumber AS seq,
 CAST((min(l_partkey) % 181)*10 - 900 AS DOUBLE) AS x, CAST(((min(l_suppkey)*97 + l_linenumber*13) % 181)*10 - 900 AS DOUBLE) AS y
 FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""),
    "road_tags": ("orders", """
SELECT CAST(floor(o_orderkey / 2500) AS BIGINT) AS scene_id, concat('w', CAST(1000000 + o_orderkey AS STRING)) AS osm_id,
 CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'motorway' WHEN '2' THEN 'primary' WHEN '3' THEN 'residential' WHEN '4' THEN 'service' ELSE 'footway' END AS highway,
 CASE WHEN o_orderkey % 7 = 0 THEN CAST(2 + o_orderkey % 30 AS STRING) END AS width_tag,
 CASE WHEN o_orderkey % 5 = 0 THEN CAST(1 + o_orderkey % 6 AS STRING) END AS lanes_tag,
 CASE WHEN o_orderstatus = 'P' THEN 'yes' END AS bridge, CASE WHEN o_orderkey % 13 = 0 THEN CAST(o_orderkey % 3 - 1 AS STRING) END AS layer_tag,
 CASE WHEN o_orderkey % 11 = 0 THEN 'tram' WHEN o_orderkey % 11 = 1 THEN 'rail' END AS railway, CASE WHEN o_orderkey % 4 = 0 THEN concat('Street ', CAST(o_custkey % 40 AS STRING)) END AS name FROM {orders}"""),
    "trees": ("orders", """
SELECT CAST(floor(o_orderkey / 2500) AS BIGINT) AS scene_id, o_orderkey AS ord, CAST((o_orderkey*4241) % 1801 AS DOUBLE) - 900 AS x, CAST((o_custkey*3571 + o_orderkey) % 1801 AS DOUBLE) - 900 AS y,
 CAST(1 + o_orderkey % 19 AS DOUBLE)/2 AS radius_m FROM {orders}"""),
    "areas": ("customer", """
SELECT CAST(floor(c_custkey / 250) AS BIGINT) AS scene_id, c_custkey AS ord, concat('w', CAST(5000000 + c_custkey AS STRING)) AS osm_id,
 CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'water' ELSE 'green' END AS layer,
 CAST((c_custkey*4519) % 1601 AS DOUBLE) - 800 AS cx, CAST((c_custkey*2203) % 1601 AS DOUBLE) - 800 AS cy,
 CAST(4 + c_custkey % 60 AS DOUBLE) AS w, CAST(4 + (c_custkey*7) % 60 AS DOUBLE) AS d,
 CASE WHEN c_custkey % 4 = 0 THEN c_name END AS name FROM {customer}"""),
    "designs": ("supplier", """
SELECT CAST(s_suppkey AS BIGINT) AS design_id, CAST(floor(s_suppkey / 14) AS BIGINT) AS scene_id, 100 + (s_suppkey*13) % 157 AS plate_mm, CAST(2 + s_suppkey % 7 AS DOUBLE) AS base_mm,
 CASE s_suppkey % 3 WHEN 0 THEN 4e-1 WHEN 1 THEN 6e-1 ELSE 25e-2 END AS nozzle_mm, (s_suppkey % 4 <> 0) AS frame, CAST(CASE WHEN s_suppkey % 10 = 3 THEN 250 ELSE 250 + (s_suppkey*110) % 2760 END AS DOUBLE) AS radius_m,
 s_suppkey % 9 AS printer_ix, CASE WHEN s_suppkey % 10 = 9 THEN 'off' ELSE 'raised' END AS road_mode, CASE WHEN s_suppkey % 3 = 0 THEN 7e-1 ELSE 12e-1 END AS height_factor, s_suppkey % 4 = 1 AS tiled,
 s_suppkey % 2 = 0 AS tinted, CAST(s_suppkey % 5 + 1 AS BIGINT) AS tint_seed, CASE s_suppkey % 3 WHEN 0 THEN 210e0 WHEN 1 THEN 24e0 ELSE 95e0 END AS tint_hue, 35e-2 AS tint_saturation, 55e-2 AS tint_lightness,
 CASE WHEN s_suppkey % 2 = 0 THEN '2024-05-01' END AS day, CASE WHEN s_suppkey % 3 = 0 THEN 'A. Author' END AS author, CASE WHEN s_suppkey % 4 = 0 THEN ' Tower ' END AS hero_name, CAST(s_suppkey % 5 AS BIGINT) AS heroes, s_suppkey % 13 <> 0 AS scale_known, CASE s_suppkey % 5 WHEN 0 THEN 15e-1 WHEN 1 THEN 75e-2 ELSE 1e0 END AS multiplier, CASE WHEN s_suppkey % 4 = 2 THEN 5e-1 ELSE 0e0 END AS curve FROM {supplier}"""),
    "overrides": ("supplier nation", """
SELECT CAST(s_suppkey AS BIGINT) AS design_id, n_nationkey AS ord, CASE WHEN n_nationkey % 3 = 0 THEN 'road' ELSE 'building' END AS layer,
 CASE WHEN n_nationkey % 3 = 0 THEN concat('w', CAST(CAST(1000000 + 2500 * floor(s_suppkey / 14) + (s_suppkey*25 + n_nationkey) % 2600 AS BIGINT) AS STRING)) ELSE concat('w', CAST(CAST(380 * floor(s_suppkey / 14) + (s_suppkey*37 + n_nationkey*6) % 420 AS BIGINT) AS STRING)) END AS osm_id,
 (n_nationkey % 11 = 0) AS hidden, CASE WHEN n_nationkey % 5 = 0 THEN 15e-1 END AS height_scale, CASE WHEN n_nationkey % 6 = 0 THEN 2e0 END AS width_scale,
 CASE n_nationkey % 7 WHEN 0 THEN '#cc3322' WHEN 1 THEN '#2266aa' END AS color, n_nationkey % 4 AS slot, CASE WHEN n_nationkey % 8 = 1 THEN 'on' WHEN n_nationkey % 8 = 2 THEN 'off' END AS hero,
 CASE WHEN n_nationkey % 2 = 0 THEN 'raised' ELSE 'flush' END AS mode, CAST(n_nationkey % 3 AS DOUBLE) / 2 AS raise_mm FROM {supplier} CROSS JOIN {nation} WHERE (s_suppkey + n_nationkey) % 4 = 0"""),
    "spans": ("events", ("""
SELECT event_id, CAST(floor(user_id / 15) AS BIGINT) AS run_id, CASE WHEN event_id % 2 = 0 THEN 'main' ELSE 'worker' END AS scope, event_type AS name,
 CASE event_type WHEN 'click' THEN 'view' WHEN 'purchase' THEN 'view' WHEN 'error' THEN 'click' WHEN 'signup' THEN 'login' WHEN 'view' THEN 'view' END AS parent, event_id * 7919 % 100000 AS bytes, event_id * 104729 % 300000 AS decoded, unix_millis(CAST(ts AS TIMESTAMP)) AS ms, value AS duration_ms FROM {events}""", """
SELECT event_id, CAST(floor(user_id / 15) AS BIGINT) AS run_id, CASE WHEN event_id % 2 = 0 THEN 'main' ELSE 'worker' END AS scope, event_type AS name,
 CASE event_type WHEN 'click' THEN 'view' WHEN 'purchase' THEN 'view' WHEN 'error' THEN 'click' WHEN 'signup' THEN 'login' WHEN 'view' THEN 'view' END AS parent, event_id * 7919 % 100000 AS bytes, event_id * 104729 % 300000 AS decoded, epoch_us(ts) // 1000 AS ms, value AS duration_ms FROM {events}""")),
    "clicks": ("events", ("SELECT event_id, user_id, event_type, unix_millis(CAST(ts AS TIMESTAMP)) AS ms, value FROM {events}", "SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, value FROM {events}")),
    "jobs": ("events", ("""
SELECT event_id, user_id AS session_id, concat('j', CAST(user_id AS STRING), '-', CAST(CAST(floor(event_id/200) AS BIGINT) AS STRING)) AS job_id, CAST(floor(event_id/200) AS BIGINT) AS job_no, unix_millis(CAST(ts AS TIMESTAMP)) AS ms,
 CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, value AS progress FROM {events}""", """
SELECT event_id, user_id AS session_id, concat('j', CAST(user_id AS STRING), '-', CAST(CAST(floor(event_id/200) AS BIGINT) AS STRING)) AS job_id, CAST(floor(event_id/200) AS BIGINT) AS job_no, epoch_us(ts) // 1000 AS ms,
 CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, value AS progress FROM {events}""")),
    "places": ("customer nation region", """
SELECT c_custkey AS place_ord, concat('N', CAST(c_custkey % 1200 AS STRING)) AS id, CASE WHEN c_custkey % 9 = 4 THEN n_name WHEN c_custkey % 9 NOT IN (5,6,7) THEN c_name END AS name, CASE WHEN c_custkey % 9 <> 7 THEN n_name END AS city, r_name AS country, CASE WHEN c_custkey % 9 = 5 THEN CAST(c_custkey % 200 AS STRING) END AS number, CASE WHEN c_custkey % 9 IN (5,6) THEN 'Main Street' END AS street,
 CAST((c_custkey*7351) % 18001 AS DOUBLE)/100 - 90 AS lat, CAST((c_custkey*9973) % 36001 AS DOUBLE)/100 - 180 AS lon,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'building' WHEN 'HOUSEHOLD' THEN 'place' WHEN 'MACHINERY' THEN 'amenity' ELSE 'highway' END AS osm_key
 FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""),
    # boxes; some lean outward, some have a collapsed edge, a floating second body, a body below zero or float32 trouble far from the origin
    "vertices": ("buildings", """
SELECT ord AS mesh_id, v, CASE WHEN ord % 13 = 0 THEN 500000 + cx + (CASE WHEN v IN (1,2,5,6,9,10,13,14) THEN w ELSE -w END) / 4000
  ELSE cx + (CASE WHEN v IN (1,2,5,6,9,10,13,14) OR ord % 11 = 0 AND v = 4 THEN w / 2 ELSE -w / 2 END) * (CASE WHEN ord % 5 = 0 AND v IN (4,5,6,7) THEN 3 ELSE 1 END) END AS x,
 cy + (CASE WHEN v IN (2,3,6,7,10,11,14,15) THEN d / 2 ELSE -d / 2 END) * (CASE WHEN ord % 5 = 0 AND v IN (4,5,6,7) THEN 3 ELSE 1 END) AS y,
 CASE WHEN v >= 12 THEN CAST(9 + ord % 50 AS DOUBLE) WHEN v >= 8 THEN CAST(5 + ord % 50 AS DOUBLE) WHEN v >= 4 THEN CAST(3 + ord % 50 AS DOUBLE) WHEN ord % 37 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS z
FROM {buildings} CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15)) AS vv(v) WHERE v < 8 OR ord % 7 = 0 AND floor(ord / 380) % 3 = 0"""),
    "triangles": ("buildings", """
SELECT ord AS mesh_id, f + 12 * k AS f, a + 8 * k AS a, b + 8 * k AS b, c + 8 * k AS c FROM {buildings} CROSS JOIN (VALUES (0,0,2,1),(1,0,3,2),(2,4,5,6),(3,4,6,7),(4,0,1,5),(5,0,5,4),(6,1,2,6),(7,1,6,5),(8,2,3,7),(9,2,7,6),(10,3,0,4),(11,3,4,7)) AS ff(f,a,b,c) CROSS JOIN (VALUES (0),(1)) AS kk(k)
WHERE NOT (ord % 41 = 0 AND f = 11 AND k = 0) AND (k = 0 OR ord % 7 = 0 AND floor(ord / 380) % 3 = 0)
UNION ALL SELECT ord, 24, 0, 2, 1 FROM {buildings} WHERE ord % 43 = 0"""),
    # pixels of elevation tiles of 32 by 32: metres + 32768 = r * 256 + g + b / 256
    "pixels": ("grid", """
SELECT scene_id, CAST(floor(c / 32) AS BIGINT) AS tx, CAST(floor(r / 32) AS BIGINT) AS ty, c % 32 AS px, r % 32 AS py, CAST(floor(e / 65536) AS BIGINT) AS r, CAST(floor(e / 256) AS BIGINT) % 256 AS g, e % 256 AS b FROM (SELECT *, CAST(floor((z + 32768) * 256) AS BIGINT) AS e FROM {grid}) q"""),
    # fixed values: stages of a build, what they read of each other and of the settings
    "stage_edges": ("region", """
SELECT stage, reads FROM (VALUES ('classify','source'),('project','classify'),('clean','project'),('crop','clean'),('heights','classify'),('blocks','crop'),('blocks','heights'),('solids','blocks'),('roads','crop'),('trees','crop'),('terrain','project'),('drape','terrain'),('drape','solids'),('merge','drape'),('merge','roads'),('merge','trees'),('audit','merge'),('estimate','merge'),('export','merge')) AS e(stage, reads)"""),
    "stage_claims": ("region", """
SELECT stage, path FROM (VALUES ('project','radius_m'),('crop','radius_m'),('heights','scene_id'),('blocks','nozzle_mm'),('solids','base_mm'),('roads','nozzle_mm'),('trees','plate_mm'),('merge','frame'),('audit','printer_ix'),('estimate','plate_mm'),('export','frame'),('source','scene_id')) AS c(stage, path)"""),
    # regions of each design's model in their order, with slot, colour and heights
    "regions": ("designs", """
SELECT design_id, region, nth, 1 + (nth * (1 + design_id % 3) + design_id) % (2 + design_id % 5) AS slot, CASE (nth + design_id * 3) % 8 WHEN 0 THEN '#F5F1E8' WHEN 1 THEN '#EFEBE0' WHEN 2 THEN '#3A3F44' WHEN 3 THEN '#40454A' WHEN 4 THEN '#5C8A4A' WHEN 5 THEN '#2266AA' WHEN 6 THEN '#C9A227' ELSE '#B03A2E' END AS color,
 CASE WHEN nth = 0 THEN 0e0 ELSE base_mm + CAST((nth - 1) * (design_id % 4) AS DOUBLE) / 2 END AS z0, CASE WHEN nth = 0 THEN base_mm ELSE base_mm + CAST((nth - 1) * (design_id % 4) AS DOUBLE) / 2 + CAST(1 + (nth * 7 + design_id) % 9 AS DOUBLE) / 3 END AS z1
FROM {designs} CROSS JOIN (VALUES (0,'base'),(1,'water'),(2,'green'),(3,'roads'),(4,'buildings'),(5,'trees'),(6,'frame')) AS r(nth, region)"""),
    "swatches": ("region", """
SELECT nth, color FROM (VALUES (0,'#FFFFFF'),(1,'#F5F1E8'),(2,'#D9D4C7'),(3,'#8C8C8C'),(4,'#3A3F44'),(5,'#111111'),(6,'#2266AA'),(7,'#7FB3D5'),(8,'#5C8A4A'),(9,'#A9C99A'),(10,'#C9A227'),(11,'#B03A2E')) AS s(nth, color)"""),
    "searches": ("clicks places", "SELECT c.user_id, c.event_id, c.ms, CASE WHEN c.event_id % 2 = 0 THEN upper(p.name) ELSE p.name END AS name, p.lat, p.lon FROM {clicks} c JOIN {places} p ON p.place_ord = c.event_id % 97 WHERE p.name IS NOT NULL"),
    # settings to search: parts as controls, their kinds as sections; a stated set of queries of one or two tokens
    "entries": ("part", """
SELECT p_partkey AS entry, p_name AS label, p_type AS help, p_brand AS grp, 'control' AS kind FROM {part} UNION ALL SELECT 1000000 + min(p_partkey), p_type, concat('all of ', p_brand), 'sections', 'section' FROM {part} GROUP BY p_type, p_brand"""),
    "queries": ("region", """
SELECT query, token, count(*) OVER (PARTITION BY query) AS n_tokens FROM (VALUES ('part','part'),('economy','economy'),('brand economy','brand'),('brand economy','economy'),('e','e'),('part 1','part'),('part 1','1'),('small all','small'),('small all','all'),('conom','conom'),('standard nothing','standard'),('standard nothing','nothing'),('brand#1','brand#1'),('sections','sections')) AS q(query, token)"""),
    "templates": ("region", """
SELECT template, line FROM (VALUES (0,'{{city}}, {{country}}'),(1,'{{lat}} / {{lon}} ({{coords}})'),(2,'{{scale}} {{radius}} {{unknown}}'),(3,'{{buildings}} buildings, {{hero}} {{date}}'),(4,'by {{author}} {{state}}{{neighbourhood}}'),(5,'no token')) AS t(template, line)"""),
    # glyphs of a face by rule: printable characters but a few, in thousandths of an em
    "glyphs": ("region", ("""
SELECT code, 500 + code * 37 % 300 AS adv, 40 + code % 5 * 10 AS lft, 500 + code * 37 % 300 - 50 - code % 7 * 8 AS rgt, CASE WHEN code = 32 THEN 0 ELSE 480 + code % 9 * 30 END AS top, CASE WHEN code % 11 = 0 THEN -180 ELSE 0 END AS bot, CASE WHEN code = 32 THEN 0 ELSE 60 + code % 6 * 10 END AS stem FROM (SELECT explode(sequence(32, 126)) AS code) g WHERE code NOT IN (35, 64, 92, 126)""", """
SELECT code, 500 + code * 37 % 300 AS adv, 40 + code % 5 * 10 AS lft, 500 + code * 37 % 300 - 50 - code % 7 * 8 AS rgt, CASE WHEN code = 32 THEN 0 ELSE 480 + code % 9 * 30 END AS top, CASE WHEN code % 11 = 0 THEN -180 ELSE 0 END AS bot, CASE WHEN code = 32 THEN 0 ELSE 60 + code % 6 * 10 END AS stem FROM (SELECT CAST(unnest(range(32, 127)) AS INT) AS code) g WHERE code NOT IN (35, 64, 92, 126)""")),
    # picks in a model: where a tree stands, or an owner's number, that of some is no feature's
    "picks": ("trees", """
SELECT scene_id, ord AS pick_id, CASE ord % 3 WHEN 0 THEN 'building' WHEN 1 THEN 'road' ELSE 'area' END AS layer, x, y, CASE WHEN ord % 3 = 0 THEN ord % 2100 END AS owner FROM {trees}"""),
    # fixed values: beds, slots and heights of printers
    "printers": ("region", """
SELECT printer_ix, plate_x, plate_y, slots, ceiling FROM (VALUES (0,340,320,4,340),(1,256,256,4,256),(2,256,256,4,256),(3,256,256,4,256),(4,180,180,4,180),(5,250,210,1,220),(6,180,180,1,180),(7,220,220,1,250),(8,256,256,4,256)) AS p(printer_ix, plate_x, plate_y, slots, ceiling)"""),
    # the faces that a model ships: centres moved a little, those of some meshes too far to be known
    "shipped": ("triangles vertices buildings", """
SELECT b.scene_id, t.mesh_id * 32 + t.f AS shipped, (p.x + q.x + r.x) / 3 + (CASE WHEN t.mesh_id % 17 = 0 THEN 1e-2 ELSE 4e-4 END) AS x, (p.y + q.y + r.y) / 3 AS y, (p.z + q.z + r.z) / 3 AS z
FROM {triangles} t JOIN {vertices} p ON p.mesh_id = t.mesh_id AND p.v = t.a JOIN {vertices} q ON q.mesh_id = t.mesh_id AND q.v = t.b JOIN {vertices} r ON r.mesh_id = t.mesh_id AND r.v = t.c JOIN {buildings} b ON b.ord = t.mesh_id WHERE t.f % 3 <> 1"""),
    "grid": ("embeddings", ("SELECT CAST(floor(vec_id / 64) AS BIGINT) AS scene_id, vec_id % 64 AS r, CAST(c AS BIGINT) AS c, CAST(v AS DOUBLE)*1000 AS z FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS c, v", "SELECT CAST(floor(vec_id / 64) AS BIGINT) AS scene_id, vec_id % 64 AS r, CAST(generate_subscripts(embedding,1)-1 AS BIGINT) AS c, CAST(unnest(embedding) AS DOUBLE)*1000 AS z FROM {embeddings}")),
}

# areas as rings in the shapes of footprints
BINDINGS["area_rings"] = ("areas", tuple(s.replace("SELECT scene_id, ord, osm_id,", "SELECT scene_id, ord, osm_id, layer, name,").replace("{buildings}", "{areas}") for s in BINDINGS["polygons"][1]))


def _pieces(side: str, *more: str) -> str:
    """The shapes of ``side`` as rectangles that do not overlap; oracles measure with these."""
    cut = f"SELECT scene_id, ord{''.join(', ' + c for c in more)}, {{}} AS x0, {{}} AS x1, {{}} AS y0, {{}} AS y1 FROM {{{{{side}}}}} WHERE {{}}"
    left, right, low, high = "cx - w / 2", "cx + w / 2", "cy - d / 2", "cy + d / 2"
    ell, court = "ord % 4 = 2", "ord % 4 = 3"
    rows = [(left, right, low, high, "ord % 4 < 2"), (left, right, low, "cy", ell), (left, "cx", "cy", high, ell), (left, "cx - w / 4", low, high, court), ("cx + w / 4", right, low, high, court), ("cx - w / 4", "cx + w / 4", low, "cy - d / 4", court), ("cx - w / 4", "cx + w / 4", "cy + d / 4", high, court)]
    return " UNION ALL ".join(cut.format(*r) for r in rows)


# designs that are printed in tiles: how many, over the scene's square
BINDINGS["tilings"] = ("designs", "SELECT design_id, scene_id, 1 + CAST(design_id % 4 AS INT) AS cols, 2 + CAST(design_id % 3 AS INT) AS rws, -900e0 AS left_x, 900e0 AS right_x, -900e0 AS low_y, 900e0 AS high_y FROM {designs} WHERE design_id % 7 < 2")
# two snapshots of each design's leaves, and the stages whose output stays equal in the second
BINDINGS["leaf_snapshots"] = ("designs", "SELECT design_id, 'plate_mm' AS path, CAST(plate_mm AS STRING) AS old, CAST(CASE WHEN design_id % 4 = 0 THEN plate_mm + 2 ELSE plate_mm END AS STRING) AS new FROM {designs} UNION ALL SELECT design_id, 'nozzle_mm', CAST(nozzle_mm AS STRING), CAST(CASE WHEN design_id % 4 = 1 THEN nozzle_mm * 2 ELSE nozzle_mm END AS STRING) FROM {designs} UNION ALL SELECT design_id, 'radius_m', CAST(radius_m AS STRING), CAST(CASE WHEN design_id % 4 = 2 THEN radius_m + 10 ELSE radius_m END AS STRING) FROM {designs} UNION ALL SELECT design_id, 'frame', CAST(frame AS STRING), CAST(CASE WHEN design_id % 12 = 3 THEN NOT frame ELSE frame END AS STRING) FROM {designs}")
BINDINGS["equal_outputs"] = ("designs", "SELECT design_id, 'clean' AS stage FROM {designs} UNION ALL SELECT design_id, 'crop' FROM {designs} WHERE design_id % 8 = 2")
# tags of all features, those that classification reads
BINDINGS["feature_tags"] = ("buildings road_tags areas trees", """
SELECT scene_id, osm_id, building, CAST(NULL AS STRING) AS highway, CAST(NULL AS STRING) AS railway, CAST(NULL AS STRING) AS tunnel, CAST(NULL AS STRING) AS layer_tag, CAST(NULL AS STRING) AS water, CAST(NULL AS STRING) AS green, CAST(NULL AS STRING) AS tree FROM {buildings}
 UNION ALL SELECT scene_id, osm_id, NULL, CASE WHEN railway = 'rail' THEN NULL ELSE highway END, railway, CASE WHEN bridge IS NULL AND width_tag IS NOT NULL THEN 'yes' END, layer_tag, NULL, NULL, NULL FROM {road_tags}
 UNION ALL SELECT scene_id, osm_id, CASE WHEN ord % 7 = 0 THEN 'no' WHEN ord % 7 = 1 THEN 'boathouse' END, NULL, NULL, NULL, NULL, CASE WHEN layer = 'water' THEN 'water' END, CASE WHEN layer = 'green' OR ord % 5 = 0 THEN 'grass' END, NULL FROM {areas}
 UNION ALL SELECT scene_id, concat('n', CAST(ord AS STRING)), NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'tree' FROM {trees}""")
# documents with a place at the end, as notes of where something was seen
BINDINGS["notes"] = ("documents", "SELECT doc_id, concat(coalesce(text, ''), CASE WHEN doc_id % 3 = 0 THEN concat(' seen at ', CAST(round(CAST((doc_id * 7351) % 18001 AS DOUBLE) / 100 - 90 + 1e-3, 3) AS STRING), ', ', CAST(round(CAST((doc_id * 9973) % 36001 AS DOUBLE) / 100 - 180 + 1e-3, 3) AS STRING)) WHEN doc_id % 3 = 1 THEN concat(' near ', CAST(doc_id % 90 AS STRING), '°', CAST(doc_id % 60 AS STRING), '''15\"', CASE WHEN doc_id % 2 = 0 THEN 'N' ELSE 'S' END, ', ', CAST(doc_id % 180 AS STRING), '°30''0\"', CASE WHEN doc_id % 4 < 2 THEN 'E' ELSE 'W' END) ELSE ' no place' END) AS text FROM {documents}")
# samples of each scene's elevation tiles: 8 to 67 a side, some windows reach beyond the tiles
BINDINGS["terrain_windows"] = ("embeddings", "SELECT scene_id, CAST(8 + scene_id * 31 % 60 AS INT) AS n, 32 AS tile_px, 2 AS cols, 2 AS rws, 4e0 - 5 * (scene_id % 3) AS x_from, 60e0 + scene_id % 2 * 7 AS x_to, 3e0 AS y_from, 61e0 + scene_id % 5 AS y_to FROM (SELECT DISTINCT CAST(floor(vec_id / 64) AS BIGINT) AS scene_id FROM {embeddings}) s")
BINDINGS["tree_tags"] = ("trees", "SELECT scene_id, concat('n', CAST(ord AS STRING)) AS osm_id, CASE ord % 5 WHEN 0 THEN concat(CAST(CAST(radius_m * 2 AS INT) AS STRING), ' m') WHEN 1 THEN concat(CAST(CAST(radius_m * 10 AS INT) AS STRING), ',5') WHEN 2 THEN '-3' WHEN 3 THEN concat('9', chr(39)) END AS crown_tag FROM {trees}")
# the square that a scene is cut to; these scenes are drawn at a quarter of what was asked for
BINDINGS["crops"] = ("requests", "SELECT scene_id, least(radius_m, 3000e0) * 25e-2 AS half FROM {requests}")
# places as a geocoder's features: some without a name, without an id, beyond the poles, broken, or with little more than an address
BINDINGS["place_features"] = ("places", """
SELECT place_ord, CASE WHEN place_ord % 83 = 7 THEN '{{"type":"Feature"' WHEN place_ord % 83 = 8 THEN '{{"type":"Feature","geometry":{{"coordinates":[1.5]}},"properties":{{"name":"x"}}}}' ELSE concat('{{"type":"Feature","geometry":{{"type":"Point","coordinates":[', CAST(lon + 5e-3 AS STRING), ',', CAST(lat + CASE WHEN place_ord % 61 = 3 THEN 200e0 ELSE 5e-3 END AS STRING), ']}},"properties":{{',
 CASE WHEN place_ord % 5 = 4 THEN '' ELSE concat('"osm_type":"N","osm_id":', CAST(place_ord % 1200 AS STRING), ',') END, '"osm_key":"', CASE place_ord % 7 WHEN 0 THEN 'place' WHEN 1 THEN 'Building' WHEN 2 THEN 'highway' WHEN 3 THEN 'shop' WHEN 4 THEN 'boundary' ELSE 'natural' END, '","osm_value":"', CASE place_ord % 6 WHEN 0 THEN 'city' WHEN 1 THEN 'hamlet' WHEN 2 THEN 'borough' WHEN 3 THEN 'administrative' ELSE 'yes' END, '","type":"', CASE place_ord % 4 WHEN 0 THEN 'district' WHEN 1 THEN 'street' ELSE 'other' END, '"',
 coalesce(concat(',"name":"', CASE WHEN place_ord % 11 = 5 THEN '  ' ELSE name END, '"'), ''), coalesce(concat(',"housenumber":"', number, '"'), ''), coalesce(concat(',"street":"', street, '"'), ''), coalesce(concat(',"city":"', city, '","county":"', lower(city), '"'), ''), CASE WHEN place_ord % 9 = 7 AND place_ord % 2 = 0 THEN '' ELSE concat(',"country":"', country, '"') END, '}}',
 CASE place_ord % 3 WHEN 0 THEN concat(',"address":{{"town":"', country, '","county":"C","suburb":"S"}}') WHEN 1 THEN ',"address":{{"county":"C","state":" ","country":"D","quarter":"Q"}}' ELSE '' END, '}}') END AS feature FROM {places}""")
# an earlier version of the footprints: some not mapped yet, some gone since, some moved, some drawn a little or much smaller
BINDINGS["earlier_buildings"] = ("buildings", "SELECT osm_id, cx + CASE WHEN ord % 25 = 4 THEN 5e-1 ELSE 0e0 END AS cx, cy, w + CASE WHEN ord % 30 = 8 THEN 4e-3 WHEN ord % 30 = 9 THEN -2e0 ELSE 0e0 END AS w, d FROM {buildings} WHERE ord % 40 <> 3 UNION ALL SELECT concat(osm_id, '-old'), cx, cy, w, d FROM {buildings} WHERE ord % 60 = 1")
BINDINGS["mesh_plates"] = ("buildings", "SELECT ord AS mesh_id, CASE WHEN ord % 6 = 0 THEN 40e0 WHEN ord % 6 = 1 THEN 180e0 ELSE 256e0 END AS plate_mm FROM {buildings}")
BINDINGS["mesh_slots"] = ("buildings", "SELECT ord AS mesh_id, 1 + ord % 4 AS slot FROM {buildings}")
# designs as documents: some with unknown keys, wrong kinds, values out of range or no choice, texts and lists too long, or no JSON
BINDINGS["design_files"] = ("designs", """
SELECT design_id, CASE WHEN design_id % 29 = 11 THEN '{{"plate_mm":' WHEN design_id % 29 = 12 THEN '[1,2]' ELSE concat(
 '{{"schema_version":4,"plate_mm":', CAST(plate_mm + CASE WHEN design_id % 17 = 5 THEN 200 ELSE 0 END AS STRING), ',"nozzle_mm":', CASE printer_ix % 3 WHEN 0 THEN '0.4' WHEN 1 THEN '0.6' ELSE '0.25' END,
 ',"base_thickness_mm":', CASE WHEN design_id % 19 = 3 THEN '"3"' ELSE CAST(CAST(base_mm AS INT) AS STRING) END, ',"road_mode":"', CASE WHEN design_id % 23 = 7 THEN 'sunk' WHEN design_id % 3 = 0 THEN 'off' ELSE 'engrave' END, '","frame":', CASE WHEN frame THEN 'true' ELSE 'false' END,
 ',"frame_style":{{"shadow_gap":{{"enabled":', CASE WHEN design_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"width_mm":1.5', CASE WHEN design_id % 31 = 4 THEN ',"glow":{{"a":[1]}}' ELSE '' END, '}},"corner":"rounded"}},"colour":{{"region_slots":{{"water":', CAST(1 + design_id % 18 AS STRING), '}},"gradient":{{"slots":[1,4]}},"tint":', CASE WHEN design_id % 37 = 9 THEN 'null' ELSE '{{"seed":7}}' END, '}}',
 ',"place":{{"author":"', repeat('x', CAST(design_id % 70 AS INT)), '"}},"labels":[{{"text":"A","size_mm":', CAST(2 + design_id % 8 AS STRING), '}},{{"text":"Bridge","layer":"road"}}],"hero_building_ids":["w1","w2"]', CASE WHEN design_id % 13 = 2 THEN ',"glitter":"yes"' ELSE '' END, '}}') END AS body FROM {designs}""")
BINDINGS["building_pieces"] = ("buildings", _pieces("buildings"))
BINDINGS["area_pieces"] = ("areas", _pieces("areas", "layer"))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir`` or a view over them; ``stream:x`` is the view x of a streamed table."""
    live = name.startswith("stream:")
    name = name.removeprefix("stream:")
    if name not in BINDINGS:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return stream(spark, f"{sf_dir}/{name}.parquet", table) if live else table
    inputs, text = BINDINGS[name]
    return spark.sql(text if isinstance(text, str) else text[0], **{i: frame(spark, sf_dir, f"stream:{i}" if live else i) for i in inputs.split()})
