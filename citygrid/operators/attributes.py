"""Classification and attributes of features from their tags."""

from citygrid.operators import operator

# fixed values: metres by building type, by road class, classes of roads, other limits
TYPE_HEIGHTS = "('skyscraper',120e0),('church',25e0),('cathedral',25e0),('hospital',30e0),('apartments',18e0),('commercial',12e0),('retail',12e0),('industrial',10e0),('house',7e0),('detached',7e0),('garage',3e0),('garages',3e0),('shed',3e0)"
ROAD_WIDTHS = "('motorway',24e0,'motorway'),('trunk',20e0,'motorway'),('primary',16e0,'primary'),('secondary',12e0,'secondary'),('tertiary',10e0,'secondary'),('residential',8e0,'residential'),('unclassified',8e0,'residential'),('service',5e0,'service'),('pedestrian',6e0,'path'),('footway',3e0,'path')"


def metres(tag: str) -> str:
    """Metres of a length tag: the first of a list; feet and inches, units, decimal commas."""
    t = f"replace(trim(regexp_extract({tag}, '^[^;]*', 0)), ',', '.')"
    feet = f"""regexp_extract({t}, '^([0-9.]+) *''( *([0-9.]+) *")?$', 1)"""
    inches = f"""regexp_extract({t}, '^([0-9.]+) *''( *([0-9.]+) *")?$', 3)"""
    number, unit = f"regexp_extract({t}, '^([0-9]+[.]?[0-9]*) *([a-z]*)$', 1)", f"regexp_extract({t}, '^([0-9]+[.]?[0-9]*) *([a-z]*)$', 2)"
    factor = f"CASE {unit} WHEN '' THEN 1e0 WHEN 'm' THEN 1e0 WHEN 'cm' THEN 1e-2 WHEN 'mm' THEN 1e-3 WHEN 'km' THEN 1e3 WHEN 'ft' THEN 3048e-4 END"
    value = f"CASE WHEN {feet} <> '' THEN (try_cast({feet} AS DOUBLE) * 12 + coalesce(try_cast(nullif({inches}, '') AS DOUBLE), 0)) * 254e-4 ELSE try_cast(nullif({number}, '') AS DOUBLE) * {factor} END"
    return f"nullif(greatest({value}, 0e0), 0e0)"


def jitter(duck: bool) -> str:
    unit = "CAST(CAST(concat('0x', substr(sha1(osm_id), 1, 16)) AS UBIGINT) AS DOUBLE)" if duck else "CAST(conv(substr(sha1(osm_id), 1, 16), 16, 10) AS DOUBLE)"
    return f"(1e0 + ({unit} / 18446744073709551616e0 * 2 - 1) * 6e-2)"


def heights(duck: bool) -> str:
    return f"""
SELECT scene_id, ord, osm_id, round(height_m, 6) AS height_m, height_source, CASE WHEN low > 0 AND low < height_m THEN low ELSE 0e0 END AS min_height_m, height_m >= 40 AS is_tall FROM (
 SELECT *, least(greatest(coalesce(tagged, levels * 32e-1 + coalesce(roof, 0e0), coalesce(default_m, 8e0) * {jitter(duck)}), 2e0), 600e0) AS height_m,
  CASE WHEN tagged IS NOT NULL THEN 'tag' WHEN levels IS NOT NULL THEN 'levels' ELSE 'default' END AS height_source
 FROM (SELECT b.*, {metres("b.height_tag")} AS tagged, nullif(greatest(try_cast(b.levels_tag AS DOUBLE), 0e0), 0e0) AS levels, t.default_m,
   {metres("b.roof_tag")} AS roof, coalesce({metres("b.min_height_tag")}, try_cast(b.min_level_tag AS DOUBLE) * 32e-1, 0e0) AS low
  FROM {{buildings}} b LEFT JOIN (VALUES {TYPE_HEIGHTS}) AS t(kind, default_m) ON t.kind = lower(b.building)) q) h"""


operator("resolve_heights", "buildings", heights(False), heights(True))

operator("height_source_report", "resolve_heights", """
SELECT scene_id, count(*) AS n_buildings, count_if(height_source = 'tag') AS tag, count_if(height_source = 'levels') AS levels, count_if(height_source = 'default') AS by_default,
 round(CAST(count_if(height_source = 'tag') AS DOUBLE) / count(*), 6) AS tag_ratio FROM {resolve_heights} GROUP BY scene_id""")  # fmt: skip

operator("road_widths", "road_tags", f"""
SELECT scene_id, osm_id, name, coalesce(t.class, 'residential') AS class, (bridge = 'yes') IS TRUE OR coalesce(try_cast(layer_tag AS INT), 0) > 0 AS elevated,
 least(greatest(coalesce({metres("width_tag")}, nullif(greatest(try_cast(lanes_tag AS DOUBLE), 0e0), 0e0) * 35e-1, t.width_m, 8e0), 5e-1), 60e0) AS width_m
FROM {{road_tags}} r LEFT JOIN (VALUES {ROAD_WIDTHS}) AS t(kind, width_m, class) ON t.kind = r.highway""")  # fmt: skip

# fixed values: metres by kind of rail, and of a tree without a crown
RAIL_WIDTHS, TREE_RADIUS = "('rail',5e0),('light_rail',4e0),('subway',5e0),('tram',3e0)", "4e0"
operator("resolve_widths", "road_widths feature_tags tree_tags", f"""
SELECT scene_id, 'road' AS layer, osm_id, class, elevated, width_m, CAST(NULL AS DOUBLE) AS radius_m FROM {{road_widths}}
UNION ALL SELECT scene_id, 'rail', osm_id, railway, coalesce(try_cast(layer_tag AS INT), 0) > 0, w.width_m, NULL FROM {{feature_tags}} r JOIN (VALUES {RAIL_WIDTHS}) AS w(kind, width_m) ON w.kind = r.railway WHERE highway IS NULL AND building IS NULL AND tunnel IS NULL AND coalesce(try_cast(layer_tag AS INT), 0) >= 0
UNION ALL SELECT scene_id, 'tree', osm_id, NULL, false, NULL, round(least(greatest(coalesce({metres("crown_tag")} / 2, {TREE_RADIUS}), 5e-1), 20e0), 3) FROM {{tree_tags}}""")  # fmt: skip

# why a tag is no length: not a number, or a number that is not positive
operator("tag_quality", "buildings road_tags", f"""
SELECT scene_id, tag, count(*) AS n_rows, count(value) AS parsed, count_if(value IS NULL AND try_cast(regexp_extract(raw, '^ *(-?[0-9.]+)', 1) AS DOUBLE) <= 0) AS not_positive, count_if(value IS NULL AND NOT coalesce(try_cast(regexp_extract(raw, '^ *(-?[0-9.]+)', 1) AS DOUBLE) <= 0, false)) AS not_a_length,
 min(value) AS least, round(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY value), 6) AS median, round(PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY value), 6) AS p90, max(value) AS most FROM (
 SELECT scene_id, 'height' AS tag, height_tag AS raw, {metres("height_tag")} AS value FROM {{buildings}}
 UNION ALL SELECT scene_id, 'building:levels', levels_tag, nullif(greatest(try_cast(levels_tag AS DOUBLE), 0e0), 0e0) FROM {{buildings}}
 UNION ALL SELECT scene_id, 'roof:height', roof_tag, {metres("roof_tag")} FROM {{buildings}}
 UNION ALL SELECT scene_id, 'min_height', min_height_tag, {metres("min_height_tag")} FROM {{buildings}}
 UNION ALL SELECT scene_id, 'width', width_tag, {metres("width_tag")} FROM {{road_tags}}
 UNION ALL SELECT scene_id, 'lanes', lanes_tag, nullif(greatest(try_cast(lanes_tag AS DOUBLE), 0e0), 0e0) FROM {{road_tags}}) q
WHERE raw IS NOT NULL GROUP BY scene_id, tag""")  # fmt: skip

# the first that matches: a building (not no or false), a road, a rail on the surface, water, green, a tree
_BUILT = "building IS NOT NULL AND building NOT IN ('no', 'false')"
_RAIL = "railway IN ('rail', 'tram') AND tunnel IS NULL AND coalesce(try_cast(layer_tag AS INT), 0) >= 0"
operator("classify_layer", "feature_tags", f"""
SELECT * FROM (SELECT scene_id, osm_id, CASE WHEN {_BUILT} THEN 'building' WHEN highway IS NOT NULL THEN 'road' WHEN {_RAIL} THEN 'rail' WHEN water IS NOT NULL THEN 'water' WHEN green IS NOT NULL THEN 'green' WHEN tree IS NOT NULL THEN 'tree' END AS layer,
 CASE WHEN {_BUILT} THEN concat('building=', building) WHEN highway IS NOT NULL THEN concat('highway=', highway) WHEN {_RAIL} THEN concat('railway=', railway) WHEN water IS NOT NULL THEN concat('natural=', water) WHEN green IS NOT NULL THEN concat('landuse=', green) ELSE 'natural=tree' END AS kind,
 CASE WHEN {_BUILT} THEN NULL WHEN highway IS NOT NULL THEN coalesce(t.class, 'residential') WHEN {_RAIL} THEN railway END AS class
FROM {{feature_tags}} q LEFT JOIN (VALUES {ROAD_WIDTHS}) AS t(road, width_m, class) ON t.road = q.highway) p WHERE layer IS NOT NULL""")  # fmt: skip
