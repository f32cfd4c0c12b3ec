"""Settings of designs as JSON documents: checked against a specification, merged, compared.

A document is a VARIANT, taken apart level by level: objects into their keys, lists of
objects into their items (path ``labels[].text``), lists of scalars stay one leaf. What
is unknown is not looked into, so the specification's depth bounds the levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygrid.lineage import cut
from citygrid.operators import planned

# fixed values: every leaf of a design with its kind, range or choices or longest text or most items, and standard value;
# leaves of lists have none. A line with a path and no more begins a group
LEAVES = """
schema_version number 2|3|4 4
plate_mm number 100..256 180
base_thickness_mm number 2..8 3.0
nozzle_mm number 0.1..1.2 0.4
small_scale number 0.5..1.5 1.0
large_scale number 0.5..2.0 1.0
terrain_exaggeration number 0.0..3.0 1.0
road_mode string engrave|emboss|off engrave
road_scale number 0.5..2.0 1.0
trees boolean - true
water boolean - true
frame boolean - true
city_label string <=64 ""
color_mode string single|parts single
part_colors.base string - #D8D3C6
part_colors.frame string - #3A3A3A
part_colors.buildings string - #D8D3C6
part_colors.roads string - #3A3A3A
part_colors.water string - #2F7FC1
part_colors.green string - #5A9E4B
part_colors.trees string - #5A9E4B
engravings list <=8 []
engravings[].edge string top|bottom|left|right|underside
engravings[].align string start|center|end
engravings[].text string <=64
engravings[].mode string engrave|emboss|inlay
engravings[].size_mm number 1.5..8.0
engravings[].depth_mm number 0.2..1.5
engravings[].font string sans|serif|mono
north_arrow.enabled boolean - false
north_arrow.corner string ne|nw|se|sw ne
north_arrow.size_mm number 2.0..6.0 4.0
scale_bar.enabled boolean - false
scale_bar.edge string top|bottom|left|right bottom
scale_bar.length_mode string auto|fixed auto
scale_bar.length_m number 10..5000 500
hanger string none|keyhole|magnets|cleat|easel none
underside_mark.enabled boolean - false
underside_mark.template string <=64 {city} {scale} {date}
hero_building_ids array <=12 []
hero_mode string true_height|own_color|both true_height
place.country string <=64 ""
place.state string <=64 ""
place.neighbourhood string <=64 ""
place.author string <=64 ""
regions.roads.depth_mm number 0.2..3.0 0.6
regions.roads.proud_mm number -2.0..2.0 -0.2
regions.water.depth_mm number 0.2..3.0 1.0
regions.water.proud_mm number -2.0..2.0 -0.5
regions.parks.depth_mm number 0.2..3.0 0.4
regions.parks.proud_mm number -2.0..2.0 0.0
regions.rail.depth_mm number 0.2..3.0 0.4
regions.rail.proud_mm number -2.0..2.0 0.3
regions.rail.width_m number 2..20 6.0
regions.building_skirt_mm number 0..1 0.3
colour.region_slots.base number 1..16 1
colour.region_slots.frame number 1..16 1
colour.region_slots.matting number 1..16 1
colour.region_slots.buildings number 1..16 2
colour.region_slots.hero_building number 1..16 4
colour.region_slots.roads number 1..16 4
colour.region_slots.water number 1..16 3
colour.region_slots.parks number 1..16 4
colour.region_slots.rail number 1..16 4
colour.region_slots.lettering number 1..16 4
colour.region_slots.attribution number 1..16 1
colour.region_colors.base string - #D8D3C6
colour.region_colors.frame string - #3A3A3A
colour.region_colors.matting string - #EDE9E0
colour.region_colors.buildings string - #D8D3C6
colour.region_colors.hero_building string - #E3A72F
colour.region_colors.roads string - #3A3A3A
colour.region_colors.water string - #2F7FC1
colour.region_colors.parks string - #5A9E4B
colour.region_colors.rail string - #6B6B6B
colour.region_colors.lettering string - #E3A72F
colour.region_colors.attribution string - #D8D3C6
colour.palette string <=32 default
colour.tint.enabled boolean - false
colour.tint.hue_range_deg number 0..60 12
colour.tint.lightness_range number 0..0.5 0.12
colour.tint.seed number - 1
colour.gradient.enabled boolean - false
colour.gradient.slots array <=16 [2,3]
colour.preview_theme string dark|light dark
printer_profile string custom|bambu-h2s|bambu-p1s|bambu-x1c|bambu-a1|bambu-a1-mini|prusa-mk4|prusa-mini|ender-3 custom
custom_profile.plate_x_mm number 100..400 256
custom_profile.plate_y_mm number 100..400 256
custom_profile.max_height_mm number 20..500 60
custom_profile.nozzle_mm number 0.2..1.0 0.4
custom_profile.slots number 1..16 4
custom_profile.change_gcode string - M600
export_target string bambu-3mf|generic-3mf|stl|stl-parts-zip|obj|step|color-change-3mf bambu-3mf
terrain.enabled boolean - false
terrain.smoothing number 0..5 1
heights.floor_height_m number 2..5 3.0
heights.unknown_default_m number 2..60 8.0
heights.type_defaults.house number - 6
heights.type_defaults.apartments number - 15
heights.type_defaults.commercial number - 12
heights.type_defaults.retail number - 6
heights.type_defaults.industrial number - 8
heights.type_defaults.garage number - 3
bridges.enabled boolean - true
bridges.clearance_mm number 0..5 1.0
bridges.abutments boolean - true
height_exaggeration.multiplier number 0.25..4 1.0
height_exaggeration.curve number 0..1 0.0
hero_auto.enabled boolean - false
hero_auto.count number 1..12 3
tiling.enabled boolean - false
tiling.cols number 1..6 1
tiling.rows number 1..6 1
tiling.joint string dovetail|pin dovetail
tiling.tolerance_mm number 0..1 0.15
tiling.index_mark boolean - true
frame_style.profile string plain|chamfer|stepped|bevel_in|bullnose|ogee|floating plain
frame_style.corner string square|mitred|rounded square
frame_style.corner_radius_mm number 0..20 3
frame_style.lip_depth_mm number 0..3 0.4
frame_style.shadow_gap.enabled boolean - false
frame_style.shadow_gap.width_mm number 0.4..5 1.0
frame_style.shadow_gap.depth_mm number 0.2..5 0.8
frame_style.matting.enabled boolean - false
frame_style.matting.width_mm number 1..30 6
frame_style.matting.proud_mm number 0..3 0.4
frame_style.separate.enabled boolean - false
frame_style.separate.mount string snap|magnet snap
frame_style.separate.tolerance_mm number 0..1 0.2
frame_style.texture.pattern string none|brush|knurl|hatch|dots none
frame_style.texture.scale_mm number 0.3..5 1.0
frame_style.texture.depth_mm number 0.05..1 0.2
hanger_magnet.diameter_mm number 3..20 6
hanger_magnet.thickness_mm number 1..10 2
hanger_magnet.count number 1..8 2
object_overrides list <=24 []
object_overrides[].osm_id string <=32
object_overrides[].layer string building|road|water|green
object_overrides[].hidden boolean -
object_overrides[].height_scale number 0.1..4.0
object_overrides[].hero string inherit|on|off
object_overrides[].tint string -
object_overrides[].slot number 0..16
object_overrides[].color string -
object_overrides[].road_mode string inherit|engrave|emboss|off
object_overrides[].width_scale number 0.25..4.0
object_overrides[].raise_mm number -2.0..2.0
labels list <=12 []
labels[].target_osm_id string <=32
labels[].layer string building|road|water|green
labels[].surface string building_top|ground
labels[].u number 0..1
labels[].v number 0..1
labels[].rotation_deg number -180..180
labels[].size_mm number 1.5..8.0
labels[].mode string engrave|emboss
labels[].depth_mm number 0.2..1.5
labels[].font string sans|serif|mono
labels[].text string <=64
labels[].follow boolean -
"""
#: What says something about the document itself is no setting.
ABOUT = ("schema_version",)


def specification() -> list[tuple]:
    """(nth, path, kind, low, high, choices, most, standard) of each leaf; low .. standard may be None."""
    rows = []
    for nth, line in enumerate(LEAVES.strip().splitlines()):
        path, kind, rule, *standard = line.split(" ", 3)
        low, dots, high = rule.partition("..")
        choices = rule if "|" in rule else None
        rows.append((nth, path, kind, float(low) if dots else None, float(high) if dots else None, choices, int(rule[2:]) if rule.startswith("<=") else None, None if not standard else "" if standard[0] == '""' else standard[0]))
    return rows


SPEC = specification()
DEPTH = 1 + max(path.count(".") + path.count("[]") for _, path, *_ in SPEC)
_quoted = lambda v: "NULL" if v is None else f"{v!r}e0" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("{", "{{").replace("}", "}}") + "'"
SPEC_SQL = f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in SPEC)}) AS t(nth, path, kind, low, high, choices, most, standard))"
#: What a leaf is judged by: l (its path, kind, value and size), s (the specification).
_REASON = """CASE WHEN s.path IS NULL THEN 'unknown key' WHEN l.kind <> s.kind THEN 'wrong kind' WHEN s.low IS NOT NULL AND (try_cast(l.value AS DOUBLE) < s.low OR try_cast(l.value AS DOUBLE) > s.high) THEN 'out of range'
 WHEN s.choices IS NOT NULL AND NOT contains(concat('|', s.choices, '|'), concat('|', l.value, '|')) THEN 'not a choice' WHEN l.size > s.most THEN 'too long' END"""
_JUDGED = """
WITH spec AS {spec}, judged AS (SELECT l.design_id, l.path, l.value, s.nth, {reason} AS reason FROM {leaves} l LEFT JOIN spec s ON s.path = l.path),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY coalesce(nth, -1), path, value) AS place FROM judged WHERE reason IS NOT NULL),
 first AS (SELECT d.design_id, CASE WHEN NOT d.good THEN 'no object' ELSE r.reason END AS reason, CASE WHEN d.good THEN r.path END AS path, CASE WHEN d.good THEN r.value END AS value FROM {docs} d LEFT JOIN ranked r ON r.design_id = d.design_id AND r.place = 1)
SELECT f.design_id, f.reason IS NULL AS accepted, CASE WHEN f.reason IS NULL THEN s.path ELSE f.path END AS path, CASE WHEN f.reason IS NULL THEN coalesce(l.value, s.standard) ELSE f.value END AS value, f.reason, f.n_reason FROM (
 SELECT *, count(*) OVER (PARTITION BY reason) AS n_reason FROM first) f LEFT JOIN (SELECT * FROM spec WHERE standard IS NOT NULL AND kind <> 'list') s ON f.reason IS NULL LEFT JOIN {leaves} l ON f.reason IS NULL AND l.design_id = f.design_id AND l.path = s.path"""
_DIFF = """
SELECT design_id, path, value, standard, grp, count(*) OVER (PARTITION BY design_id, grp) AS changed_in_group FROM (
 SELECT l.design_id, l.path, l.value, s.standard, CASE WHEN contains(l.path, '.') THEN split_part(replace(l.path, '[]', ''), '.', 1) ELSE 'design' END AS grp FROM {leaves} l JOIN {spec} s ON s.path = l.path
 WHERE s.kind <> 'list' AND s.path NOT IN ({about}) AND l.kind = s.kind AND CASE WHEN s.kind = 'number' AND s.standard IS NOT NULL THEN try_cast(l.value AS DOUBLE) <> try_cast(s.standard AS DOUBLE) ELSE l.value IS DISTINCT FROM s.standard END) q"""
_ABOUT = ", ".join(f"'{p}'" for p in ABOUT)
# in the oracle the whole tree of a document comes from one function, and the paths from its names
_TREE = r"""(SELECT design_id, path, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN CASE WHEN path IN ('engravings', 'object_overrides', 'labels') THEN 'list' ELSE 'array' END ELSE 'number' END AS kind, value, CASE type WHEN 'VARCHAR' THEN len(value) WHEN 'ARRAY' THEN json_array_length(value) END AS size FROM (
  SELECT d.design_id, regexp_replace(regexp_replace(t.fullkey, '^\$\.?', ''), '\[\d+\]', '[]', 'g') AS path, t.type, CASE WHEN t.type = 'VARCHAR' THEN json_extract_string(t.value, '$') ELSE CAST(t.value AS VARCHAR) END AS value
  FROM {design_files} d, json_tree(CASE WHEN json_valid(d.body) THEN d.body ELSE 'null' END) t) w WHERE path <> '')"""
# below what is unknown nothing counts, and objects on the way to a leaf are none
_WAYS = "SELECT path AS way FROM SPEC s UNION SELECT regexp_extract(path, '^(.*)\\.[^.]*$', 1) FROM SPEC s UNION SELECT regexp_extract(path, '^(.*)\\.[^.]*\\.[^.]*$', 1) FROM SPEC s UNION SELECT 'engravings[]' UNION SELECT 'object_overrides[]' UNION SELECT 'labels[]'".replace("SPEC", SPEC_SQL)
_DUCK_LEAVES = f"""(WITH way AS ({_WAYS}), tree AS {_TREE}
 SELECT t.* FROM tree t LEFT JOIN {SPEC_SQL} s ON s.path = t.path WHERE (s.path IS NOT NULL OR t.kind <> 'object' OR t.path NOT IN (SELECT way FROM way)) AND (NOT contains(t.path, '.') AND NOT ends_with(t.path, '[]') OR CASE WHEN ends_with(t.path, '[]') THEN left(t.path, len(t.path) - 2) ELSE regexp_extract(t.path, '^(.*)\\.[^.]*$', 1) END IN (SELECT way FROM way WHERE way NOT IN (SELECT path FROM {SPEC_SQL} z WHERE kind <> 'list'))))"""
_DUCK_DOCS = "(SELECT design_id, coalesce(json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE 'null' END) = 'OBJECT', false) AS good FROM {design_files})"


def spec_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPEC, "nth int, path string, kind string, low double, high double, choices string, most int, standard string")


def document_leaves(documents: DataFrame) -> DataFrame:
    """documents (design_id, body) -> design_id, path, kind, value, size: leaves, and the topmost of what is unknown.

    ``kind`` is string, number, boolean, null, array (of scalars), list (of objects) or, where a
    leaf should be, object. ``size`` is the length of a text or list. Bodies that are no JSON
    objects, and null ones, have no leaves.
    """
    spark = documents.sparkSession
    known = {path: kind for _, path, kind, *_ in SPEC}
    ways = {path[:k] for path in known for k in range(1, len(path)) if path[k] == "."} | {p + "[]" for p, kind in known.items() if kind == "list"}
    listed = lambda names: ", ".join(f"'{n}'" for n in sorted(names)) or "''"
    lists = {p for p, kind in known.items() if kind == "list"}
    kind = f"CASE WHEN s LIKE 'OBJECT%' THEN 'object' WHEN s LIKE 'ARRAY%' THEN CASE WHEN path IN ({listed(lists)}) THEN 'list' ELSE 'array' END WHEN s = 'STRING' THEN 'string' WHEN s = 'BOOLEAN' THEN 'boolean' WHEN s = 'VOID' THEN 'null' ELSE 'number' END"
    level = documents.select("design_id", F.lit("").alias("path"), F.expr("try_parse_json(body)").alias("v"), F.lit("object").alias("kind")).filter("schema_of_variant(v) LIKE 'OBJECT%'")
    found = None
    for _ in range(DEPTH):
        level = spark.sql(
            f"""SELECT design_id, path, v, {kind} AS kind FROM (SELECT design_id, path, v, schema_of_variant(v) AS s FROM (
 SELECT q.design_id, CASE WHEN t.key IS NULL THEN concat(q.path, '[]') WHEN q.path = '' THEN t.key ELSE concat(q.path, '.', t.key) END AS path, t.value AS v FROM {{level}} q, LATERAL variant_explode(q.v) AS t(pos, key, value)) p) r""", level=level
        )
        own = level.filter(f"NOT (kind = 'object' AND path IN ({listed(ways)}))").selectExpr("design_id", "path", "kind", "coalesce(try_variant_get(v, '$', 'string'), to_json(v)) AS value", "CASE kind WHEN 'string' THEN length(try_variant_get(v, '$', 'string')) WHEN 'list' THEN size(try_variant_get(v, '$', 'array<variant>')) WHEN 'array' THEN size(try_variant_get(v, '$', 'array<variant>')) END AS size")
        found = own if found is None else found.unionByName(own)
        level = level.filter(f"kind = 'list' OR kind = 'object' AND path IN ({listed(ways)})")
    return found


@planned("validate_params", "design_files", _JUDGED.replace("{leaves}", _DUCK_LEAVES).replace("{docs}", _DUCK_DOCS).replace("{spec}", SPEC_SQL).replace("{reason}", _REASON))
def validate_params(design_files: DataFrame) -> DataFrame:
    """Accepted designs over the standard values, a row for each leaf outside lists; rejected ones with
    what is wrong first (unknown keys, then in the specification's order), and how many have that reason."""
    spark = design_files.sparkSession
    docs = design_files.selectExpr("design_id", "coalesce(schema_of_variant(try_parse_json(body)) LIKE 'OBJECT%', false) AS good")
    return spark.sql(_JUDGED.replace("{spec}", "(SELECT * FROM {spec})").replace("{reason}", _REASON), leaves=cut(document_leaves(design_files)), docs=docs, spec=spec_frame(spark))


@planned("params_diff", "design_files", _DIFF.replace("{leaves}", _DUCK_LEAVES).replace("{spec}", SPEC_SQL).replace("{about}", _ABOUT))
def params_diff(design_files: DataFrame) -> DataFrame:
    """Leaves that differ from the standard values, with how many do in their group; every leaf of a list's items does."""
    spark = design_files.sparkSession
    return spark.sql(_DIFF.replace("{about}", _ABOUT), leaves=document_leaves(design_files), spec=spec_frame(spark))
