"""Scene aggregates, scores, advice, landmarks and per-object overrides."""

from citygrid.operators import operator

operator("scene_stats", "buildings resolve_heights designs", """
SELECT s.scene_id, coalesce(n, 0) AS n_buildings, coalesce(area, 0e0) AS footprint_m2, coalesce(round(tagged / n, 6), 0e0) AS tag_ratio, coalesce(tall, 0) AS n_tall,
 CASE WHEN coalesce(n, 0) < 20 THEN 'empty' WHEN n >= 150 AND area >= 4e-2 * 1800 * 1800 THEN 'good' ELSE 'sparse' END AS coverage
FROM (SELECT DISTINCT scene_id FROM {designs}) s LEFT JOIN (
 SELECT b.scene_id, count(*) AS n, sum(b.w * b.d) AS area, CAST(count_if(h.height_source = 'tag') AS DOUBLE) AS tagged, count_if(h.is_tall) AS tall
 FROM {buildings} b JOIN {resolve_heights} h ON h.ord = b.ord GROUP BY b.scene_id) q ON q.scene_id = s.scene_id""", merged="buildings resolve_heights")  # fmt: skip

# millimetres on the plate for a metre; walls, gaps and details on the ground that a nozzle can make
_SCALED = "(SELECT *, (plate_mm - CASE WHEN frame THEN 12 ELSE 0 END) / (2 * radius_m) AS scale, 2 * nozzle_mm / ((plate_mm - CASE WHEN frame THEN 12 ELSE 0 END) / (2 * radius_m)) AS wall, nozzle_mm / ((plate_mm - CASE WHEN frame THEN 12 ELSE 0 END) / (2 * radius_m)) AS detail FROM {designs})"
_VISIBLE = "t.radius_m * scale >= greatest(5e-1, 2 * nozzle_mm / (2 * cos(pi() / 8)))"
operator("printable_features", "buildings road_tags road_widths areas trees designs", f"""
SELECT design_id, 'building' AS layer, ord, round(width_m, 6) AS width_m, dilation > 0 AND NOT dropped AS widened, dropped, round(dilation, 6) AS dilation_m FROM (
 SELECT *, (sqrt(area) + 2 * dilation) * (sqrt(area) + 2 * dilation) < detail * detail AS dropped FROM (
  SELECT d.design_id, b.ord, b.w * b.d AS area, 2 * b.w * b.d / (b.w + b.d) AS width_m, detail, greatest(0e0, (wall - 2 * b.w * b.d / (b.w + b.d)) / 2) AS dilation FROM {{buildings}} b JOIN {_SCALED} d ON d.scene_id = b.scene_id AND abs(b.cx) <= radius_m AND abs(b.cy) <= radius_m) q) p
UNION ALL SELECT d.design_id, 'area', a.ord, NULL, false, a.w * a.d < detail * detail, NULL FROM {{areas}} a JOIN {_SCALED} d ON d.scene_id = a.scene_id
UNION ALL SELECT d.design_id, 'tree', t.ord, t.radius_m * 2, false, NOT ({_VISIBLE}), NULL FROM {{trees}} t JOIN {_SCALED} d ON d.scene_id = t.scene_id""")  # fmt: skip

operator("road_print_widths", "road_widths designs", f"""
SELECT d.design_id, r.class, count(*) AS n_roads, round(max(greatest(r.width_m, wall)), 6) AS widest_m, count_if(r.width_m < wall) AS widened FROM {{road_widths}} r JOIN {_SCALED} d ON d.scene_id = r.scene_id GROUP BY d.design_id, r.class""")  # fmt: skip

_SHARE = "CASE WHEN count_if(layer = '{l}') = 0 THEN 0e0 ELSE CAST(count_if(layer = '{l}' AND {what}) AS DOUBLE) / count_if(layer = '{l}') END"
operator("detail_report", "printable_features", f"""
SELECT design_id, n, widened, dropped, round(widened_f, 6) AS widened_fraction, round(trees_f, 6) AS trees_dropped, round(areas_f, 6) AS areas_dropped, score, CASE WHEN score >= 75 THEN 'good' WHEN score >= 45 THEN 'fair' ELSE 'poor' END AS band FROM (
 SELECT *, CAST(least(100e0, greatest(0e0, floor(100 - 100 * dropped_f - 60 * widened_f - 5 * trees_f - 5 * areas_f + 5e-1))) AS BIGINT) AS score FROM (
  SELECT design_id, count_if(layer = 'building') AS n, count_if(layer = 'building' AND widened) AS widened, count_if(layer = 'building' AND dropped) AS dropped,
   {_SHARE.format(l='building', what='widened')} AS widened_f, {_SHARE.format(l='building', what='dropped')} AS dropped_f, {_SHARE.format(l='tree', what='dropped')} AS trees_f, {_SHARE.format(l='area', what='dropped')} AS areas_f
  FROM {{printable_features}} GROUP BY design_id) q) p""")  # fmt: skip

# the largest radius (steps of 10 down to 250) and the smallest plate (100 to 256 in steps of 2) at which less than a
# quarter of the scene's buildings is widened. So many are narrower than a wall exactly when the wall is wider than the
# width of that rank: one threshold a scene, no building meets a candidate. The oracle counts
_WALL = "2 * d.nozzle_mm * 2 * {r} / ({p} - CASE WHEN d.frame THEN 12 ELSE 0 END)"
_WIDTHS = "SELECT scene_id, 2 * w * d / (w + d) AS width FROM {buildings}"
_ADVICE = f"""
SELECT d.design_id, d.now_wide, CASE WHEN d.now_wide THEN r.radius_m END AS radius_m, CASE WHEN d.now_wide THEN p.plate_mm END AS plate_mm
FROM (SELECT d.design_id, coalesce(NOT FITS_NOW, false) AS now_wide FROM JOINED) d
LEFT JOIN (SELECT design_id, max(radius) AS radius_m FROM RADII WHERE radius < radius_m AND FITS_R GROUP BY design_id) r ON r.design_id = d.design_id
LEFT JOIN (SELECT design_id, min(plate) AS plate_mm FROM PLATES WHERE plate > plate_mm AND FITS_P GROUP BY design_id) p ON p.design_id = d.design_id"""
_NOW, _BY_R, _BY_P = _WALL.format(r="d.radius_m", p="d.plate_mm"), _WALL.format(r="d.radius", p="d.plate_mm"), _WALL.format(r="d.radius_m", p="d.plate")
operator("detail_sweep", "buildings designs", f"""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY width) AS nth, count(*) OVER (PARTITION BY scene_id) AS n FROM ({_WIDTHS}) w),
 level AS (SELECT scene_id, max(CASE WHEN nth = ceil(25e-2 * n) THEN width END) AS level FROM ranked GROUP BY scene_id),
 j AS (SELECT d.*, l.level FROM {{designs}} d LEFT JOIN level l ON l.scene_id = d.scene_id)
""" + _ADVICE.replace("FITS_NOW", f"{_NOW} <= d.level").replace("JOINED", "j d").replace("RADII", "(SELECT *, explode(transform(sequence(25, CAST(floor(greatest(250, radius_m) / 10) AS INT)), k -> k * 10)) AS radius FROM j) d").replace("FITS_R", f"{_BY_R} <= d.level").replace("PLATES", "(SELECT *, explode(sequence(100, 256, 2)) AS plate FROM j) d").replace("FITS_P", f"{_BY_P} <= d.level"), f"""
WITH widths AS ({_WIDTHS}), radii AS (SELECT d.*, 10 * k AS radius FROM {{designs}} d, (SELECT unnest(range(25, 310)) AS k) kk WHERE 10 * k <= d.radius_m), plates AS (SELECT d.*, CAST(k AS INT) AS plate FROM {{designs}} d, (SELECT unnest(range(100, 257, 2)) AS k) kk),
 by_r AS (SELECT d.design_id, d.radius, d.radius_m, count_if(w.width < {_BY_R}) / count(*) < 25e-2 AS fits FROM radii d JOIN widths w ON w.scene_id = d.scene_id GROUP BY d.design_id, d.radius, d.radius_m),
 by_p AS (SELECT d.design_id, d.plate, d.plate_mm, count_if(w.width < {_BY_P}) / count(*) < 25e-2 AS fits FROM plates d JOIN widths w ON w.scene_id = d.scene_id GROUP BY d.design_id, d.plate, d.plate_mm),
 by_now AS (SELECT d.design_id, count(w.width) > 0 AND NOT count_if(w.width < {_NOW}) / greatest(1, count(w.width)) < 25e-2 AS now_wide FROM {{designs}} d LEFT JOIN widths w ON w.scene_id = d.scene_id GROUP BY d.design_id)
SELECT d.design_id, d.now_wide, CAST(CASE WHEN d.now_wide THEN (SELECT max(radius) FROM by_r r WHERE r.design_id = d.design_id AND r.fits AND r.radius < r.radius_m) END AS INT) AS radius_m, CASE WHEN d.now_wide THEN (SELECT min(plate) FROM by_p p WHERE p.design_id = d.design_id AND p.fits AND p.plate > p.plate_mm) END AS plate_mm FROM by_now d""")  # fmt: skip

# the highest point of base and frame, buildings (a design's scale, heroes at 1 or more, at least 0.6 mm) and visible trees,
# against the printer's ceiling; one row a scene meets the designs, and a design's own heroes
_FACTOR = "d.height_factor"
#: A height as it is printed: times the multiplier; with a curve, heights above 50 m gain less and those below it more.
_raised = lambda h: f"CASE WHEN d.curve > 0 THEN d.multiplier * 50 * pow({h} / 50, 1 - 6e-1 * d.curve) ELSE {h} * d.multiplier END"
operator("predicted_top", "resolve_heights trees designs printers hero_selection", f"""
WITH tall AS (SELECT scene_id, max(height_m) AS height_m, count(*) AS n FROM {{resolve_heights}} GROUP BY scene_id),
 hero AS (SELECT s.design_id, max(h.height_m) AS height_m FROM {{hero_selection}} s JOIN {{resolve_heights}} h ON h.osm_id = s.osm_id GROUP BY s.design_id),
 green AS (SELECT scene_id, max(radius_m) AS radius_m FROM {{trees}} GROUP BY scene_id)
SELECT design_id, n, round(top, 6) AS top_mm, ceiling, top >= ceiling AS too_tall FROM (
 SELECT d.design_id, coalesce(t.n, 0) AS n, p.ceiling, greatest(base_mm + CASE WHEN frame THEN 2 ELSE 0 END, coalesce(base_mm + greatest(6e-1, ({_raised('t.height_m')}) * scale * {_FACTOR}), 0e0), coalesce(base_mm + greatest(6e-1, ({_raised('h.height_m')}) * scale * greatest(1e0, {_FACTOR})), 0e0), coalesce(CASE WHEN g.radius_m * scale >= 5e-1 THEN base_mm + 3 * g.radius_m * scale END, 0e0)) AS top
 FROM {_SCALED} d JOIN {{printers}} p ON p.printer_ix = d.printer_ix LEFT JOIN tall t ON t.scene_id = d.scene_id LEFT JOIN hero h ON h.design_id = d.design_id LEFT JOIN green g ON g.scene_id = d.scene_id) q""", merged="hero_selection resolve_heights")  # fmt: skip

# names by falling area while they fit the budget; one that does not fit is passed over and smaller ones go on
NAME_BYTES = 96000
_COST = "8 + 2 + octet_length(encode(name, 'UTF-8'))"
operator("name_budget", "buildings", f"""
WITH g AS (SELECT scene_id, array_sort(collect_list(named_struct('back', -(w * d), 'ord', ord, 'cost', {_COST}))) AS names FROM {{buildings}} WHERE name IS NOT NULL GROUP BY scene_id),
 f AS (SELECT scene_id, size(names) AS named, aggregate(names, 0L, (a, x) -> a + x.cost) AS total, aggregate(names, named_struct('spent', 0L, 'kept', 0L), (s, x) -> CASE WHEN s.spent + x.cost <= {NAME_BYTES} THEN named_struct('spent', s.spent + x.cost, 'kept', s.kept + 1L) ELSE s END) AS s FROM g)
SELECT scene_id, CAST(named AS BIGINT) AS named, CASE WHEN total <= {NAME_BYTES} THEN total ELSE s.spent END AS bytes, CASE WHEN total <= {NAME_BYTES} THEN 0L ELSE named - s.kept END AS dropped FROM f""", f"""
WITH RECURSIVE o AS (SELECT scene_id, 10 + octet_length(encode(name)) AS cost, row_number() OVER (PARTITION BY scene_id ORDER BY -(w * d), ord) AS nth FROM {{buildings}} WHERE name IS NOT NULL),
 f AS (SELECT DISTINCT scene_id, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS spent, CAST(0 AS BIGINT) AS dropped FROM o
  UNION ALL SELECT o.scene_id, o.nth, CASE WHEN f.spent + o.cost <= {NAME_BYTES} THEN f.spent + o.cost ELSE f.spent END, CASE WHEN f.spent + o.cost <= {NAME_BYTES} THEN f.dropped ELSE f.dropped + 1 END FROM f JOIN o ON o.scene_id = f.scene_id AND o.nth = f.nth + 1)
SELECT scene_id, max(nth) AS named, max(spent) AS bytes, max(dropped) AS dropped FROM f GROUP BY scene_id""")  # fmt: skip

operator("scene_warnings", "scene_stats predicted_top designs name_budget", """
SELECT d.design_id, w.id, w.severity FROM {designs} d JOIN {scene_stats} s ON s.scene_id = d.scene_id LEFT JOIN {predicted_top} p ON p.design_id = d.design_id LEFT JOIN {name_budget} b ON b.scene_id = d.scene_id
CROSS JOIN (VALUES ('coverage-empty', 'block'), ('coverage-sparse', 'warn'), ('model-too-tall', 'block'), ('estimated-heights', 'warn'), ('names-over-budget', 'info')) AS w(id, severity)
WHERE (w.id = 'coverage-empty' AND s.coverage = 'empty') OR (w.id = 'coverage-sparse' AND s.coverage = 'sparse') OR (w.id = 'model-too-tall' AND p.too_tall) OR (w.id = 'estimated-heights' AND s.tag_ratio < 15e-2) OR (w.id = 'names-over-budget' AND b.dropped > 0)""")  # fmt: skip

# a design's warnings and findings by id, a finding in place of a warning of its id
operator("issue_rollup", "scene_warnings printability_audit", """
WITH i AS (SELECT design_id, id, severity, row_number() OVER (PARTITION BY design_id, id ORDER BY source DESC) AS nth FROM (
 SELECT design_id, id, CASE severity WHEN 'block' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'info' END AS severity, 0 AS source FROM {scene_warnings} UNION ALL SELECT DISTINCT design_id, id, severity, 1 FROM {printability_audit}) q)
SELECT design_id, count(*) AS n, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings, count_if(severity = 'info') AS notes, min(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS worst,
 count_if(id IN ('coverage-empty', 'coverage-sparse', 'estimated-heights', 'names-over-budget')) AS place_group, count_if(id IN ('model-too-tall', 'exceeds-profile-plate', 'tile-exceeds-plate')) AS size_group FROM i WHERE nth = 1 GROUP BY design_id""")  # fmt: skip

operator("hero_scores", "buildings resolve_heights", """
SELECT scene_id, osm_id, round(score, 9) AS score, row_number() OVER (PARTITION BY scene_id ORDER BY round(score, 9) DESC, osm_id) AS place FROM (
 SELECT b.scene_id, b.osm_id, 5e-1 * h.height_m / max(h.height_m) OVER (PARTITION BY b.scene_id) + 2e-1 * (b.w * b.d) / max(b.w * b.d) OVER (PARTITION BY b.scene_id)
  + 3e-1 * (CAST(tourism AS INT) + CAST(historic AS INT) + CAST(wikidata AS INT) + CAST(tourism OR historic OR wikidata AS INT)) / 4 AS score
 FROM {buildings} b JOIN {resolve_heights} h ON h.ord = b.ord) q""", merged="buildings resolve_heights")  # fmt: skip

operator("hero_selection", "hero_scores overrides designs", """
WITH manual AS (SELECT design_id, osm_id, row_number() OVER (PARTITION BY design_id ORDER BY min(ord)) AS place FROM {overrides} WHERE layer = 'building' AND slot = 1 GROUP BY design_id, osm_id),
 auto AS (SELECT d.design_id, h.osm_id, 1000000 + row_number() OVER (PARTITION BY d.design_id ORDER BY h.place) AS place FROM {designs} d JOIN {hero_scores} h ON h.scene_id = d.scene_id AND h.place <= 40
  LEFT JOIN manual m ON m.design_id = d.design_id AND m.osm_id = h.osm_id WHERE m.osm_id IS NULL),
 all_of AS (SELECT design_id, osm_id, place, true AS manual FROM manual UNION ALL SELECT design_id, osm_id, place, false FROM auto)
SELECT design_id, osm_id, manual, place FROM (SELECT design_id, osm_id, manual, row_number() OVER (PARTITION BY design_id ORDER BY place) AS place FROM all_of) q WHERE manual OR place <= 12""")  # fmt: skip

# the last row of an id wins; hidden features and roads set to off go
operator("override_apply", "overrides resolve_heights road_widths designs hero_selection", """
WITH last_of AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY design_id, layer, osm_id ORDER BY ord DESC) AS back FROM {overrides}) q WHERE back = 1)
SELECT d.design_id, 'building' AS layer, h.osm_id, round(h.height_m * coalesce(o.height_scale, 1e0), 3) AS height_m, CAST(NULL AS DOUBLE) AS width_m, o.color AS tint, h.height_m * coalesce(o.height_scale, 1e0) >= 40 AS is_tall, CASE o.hero WHEN 'on' THEN true WHEN 'off' THEN false ELSE s.osm_id IS NOT NULL END AS hero
FROM {designs} d JOIN {resolve_heights} h ON h.scene_id = d.scene_id LEFT JOIN last_of o ON o.design_id = d.design_id AND o.layer = 'building' AND o.osm_id = h.osm_id LEFT JOIN {hero_selection} s ON s.design_id = d.design_id AND s.osm_id = h.osm_id WHERE coalesce(o.hidden, false) = false
UNION ALL SELECT d.design_id, 'road', r.osm_id, NULL, round(r.width_m * coalesce(o.width_scale, 1e0), 3), o.color, false, false
FROM {designs} d JOIN {road_widths} r ON r.scene_id = d.scene_id LEFT JOIN last_of o ON o.design_id = d.design_id AND o.layer = 'road' AND o.osm_id = r.osm_id WHERE coalesce(o.hidden, false) = false AND coalesce(o.mode, 'raised') <> 'off' AND d.road_mode <> 'off'""")  # fmt: skip

# rows that ask for a region of their own, by what makes it one; the first four of a design become regions
operator("override_groups", "overrides", """
SELECT design_id, layer, slot, color, mode, raise_mm, first_ord, n, place, place <= 4 AS is_region FROM (
 SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY first_ord, layer) AS place FROM (
  SELECT design_id, layer, slot, color, mode, raise_mm, min(ord) AS first_ord, count(*) AS n FROM {overrides} WHERE slot > 0 OR color IS NOT NULL GROUP BY design_id, layer, slot, color, mode, raise_mm) q) p""")  # fmt: skip

operator("override_reconcile", "overrides buildings road_tags", """
SELECT o.design_id, count_if(p.osm_id IS NOT NULL) AS matched, count_if(p.osm_id IS NULL) AS unmatched FROM {overrides} o
LEFT JOIN (SELECT DISTINCT 'building' AS layer, osm_id FROM {buildings} UNION ALL SELECT DISTINCT 'road', osm_id FROM {road_tags}) p ON p.layer = o.layer AND p.osm_id = o.osm_id GROUP BY o.design_id""")  # fmt: skip

def parity(left: str, right: str, key: str, fields: list[str], tolerance: str = "1e-2") -> str:
    """Rows of two tables that are added, removed, or apart by more than the tolerance in a field, with the first such field."""
    off = {f: f"coalesce(abs(a.{f} - b.{f}) > {tolerance}, (a.{f} IS NULL) <> (b.{f} IS NULL))" for f in fields}
    first = " ".join(f"WHEN {test} THEN '{f}'" for f, test in off.items())
    count = " + ".join(f"CASE WHEN {test} THEN 1 ELSE 0 END" for test in off.values())
    return f"""SELECT coalesce(a.{key}, b.{key}) AS {key}, CASE WHEN a.{key} IS NULL THEN 'added' WHEN b.{key} IS NULL THEN 'removed' ELSE 'changed' END AS verdict, CASE WHEN a.{key} IS NULL OR b.{key} IS NULL THEN NULL {first} END AS first_path,
 CASE WHEN a.{key} IS NULL OR b.{key} IS NULL THEN 0 ELSE {count} END AS n_fields FROM {left} a FULL OUTER JOIN {right} b ON a.{key} = b.{key} WHERE a.{key} IS NULL OR b.{key} IS NULL OR {" OR ".join(off.values())}"""


# an earlier version of a scene's features against the one now
operator("scene_parity", "buildings earlier_buildings", parity("(SELECT osm_id, cx, cy, w, d, w * d AS area FROM {earlier_buildings})", "(SELECT osm_id, cx, cy, w, d, w * d AS area FROM {buildings})", "osm_id", ["cx", "cy", "w", "d", "area"]))
