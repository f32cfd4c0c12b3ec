"""Features that belong together: twins, overlaps, areas that touch, blocks, streets.

Pairs come from equi-joins on grid cells, groups from connected components of the pairs,
which lie in a scene; the outlines of groups are united (``outlines``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrid.graph import components_nearby
from citygrid.lineage import cut
from citygrid.operators import operator, planned
from citygrid.operators.outlines import close_pairs, covered, first_cell, measured_unions, overlaps
from citygrid.operators.rings import area2, over, perimeter

FIRST_CELL = first_cell("scene_id")

def reach(edges: str) -> str:
    """The oracle's components: CTEs that end in parts(v, component)."""
    return f"""e AS ({edges}), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach AS (SELECT DISTINCT a AS v, a AS u FROM l UNION SELECT r.v, l.b FROM reach r JOIN l ON r.u = l.a), parts AS (SELECT v, min(u) AS component FROM reach GROUP BY v)"""


def grouped(name: str, inputs: str, pairs: str | Callable[..., DataFrame], plain_pairs: str, text: str, plain_text: str | None = None, members: Callable[..., DataFrame] | None = None, more: str = "") -> None:
    """An operator over components: ``pairs`` (scene_id, a, b) in SQL or as a function of the inputs, for the
    oracle ``plain_pairs``; ``text`` reads {parts} and, with ``members`` (a function of the parts and the
    inputs), {unions}: area and perimeter of each group's union. In the oracle, the CTEs ``more`` say these."""

    def plan(*given: DataFrame) -> DataFrame:
        frames = dict(zip(inputs.split(), given))
        frames |= {k: cut(v) for k, v in frames.items() if k in ("polygons", "area_rings")}  # read several times below
        spark = given[0].sparkSession
        parts = components_nearby(spark.sql(pairs, **frames) if isinstance(pairs, str) else pairs(**frames), ["scene_id"])
        views = {"parts": parts.hint("merge")} | ({"unions": measured_unions(members(parts, **frames))} if members else {})
        return spark.sql(text, **views, **frames)

    told = (plain_text or text).replace("{parts}", "parts").replace("{unions}", "unions")
    planned(name, inputs, f"WITH RECURSIVE {reach(plain_pairs)}{more}, told AS ({told}) SELECT * FROM told")(plan)


def in_groups(parts: DataFrame, polygons: DataFrame) -> DataFrame:
    """Polygons of groups of several: scene_id, g, ord, ring, holes."""
    return parts.withColumnRenamed("component", "g").join(polygons.withColumnRenamed("ord", "v"), "v").select("scene_id", "g", F.col("v").alias("ord"), "ring", "holes")


def union_ctes(pieces: str) -> str:
    """The oracle's unions(g, outline_m2, outline_m) of rectangles pieces(g, x0, x1, y0, y1): coordinates are
    compressed, and the cells of a group that a rectangle covers are summed."""
    cut = lambda a: f"c{a} AS (SELECT g, {a}, lead({a}) OVER (PARTITION BY g ORDER BY {a}) AS {a}n FROM (SELECT g, {a}0 AS {a} FROM pc UNION SELECT g, {a}1 FROM pc) u)"
    side = lambda along, across: f"CASE WHEN filled <> coalesce(lag(filled) OVER (PARTITION BY g, {across} ORDER BY {along}), false) THEN {across}n - {across} ELSE 0 END + CASE WHEN filled AND lead(filled) OVER (PARTITION BY g, {across} ORDER BY {along}) IS NULL THEN {across}n - {across} ELSE 0 END"
    return f""", pc AS ({pieces}), {cut("x")}, {cut("y")},
 cell AS (SELECT cx.g, x, xn, y, yn, EXISTS (SELECT 1 FROM pc WHERE pc.g = cx.g AND x0 <= x AND xn <= x1 AND y0 <= y AND yn <= y1) AS filled FROM cx JOIN cy ON cx.g = cy.g WHERE xn IS NOT NULL AND yn IS NOT NULL),
 unions AS (SELECT g, round(sum(CASE WHEN filled THEN (xn - x) * (yn - y) ELSE 0 END), 3) AS outline_m2, round(sum(sides), 3) AS outline_m FROM (SELECT *, {side("x", "y")} + {side("y", "x")} AS sides FROM cell) s GROUP BY g)"""


#: Rectangles of two features: what they share, and how far they are apart.
_SHARED = "greatest(0e0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0e0, least(p.y1, q.y1) - greatest(p.y0, q.y0))"
_APART = "pow(greatest(0e0, p.x0 - q.x1, q.x0 - p.x1), 2) + pow(greatest(0e0, p.y0 - q.y1, q.y0 - p.y1), 2)"

# twins: centres within 50 cm and outline areas within 5 %. The one with most holes, then of largest area, stays
_TWIN = "sqrt((a.centroid_x - b.centroid_x) * (a.centroid_x - b.centroid_x) + (a.centroid_y - b.centroid_y) * (a.centroid_y - b.centroid_y)) <= 5e-1 AND abs(a.outline_m2 - b.outline_m2) <= 5e-2 * greatest(a.outline_m2, b.outline_m2)"
_POINTS = covered("{footprint_metrics}", "centroid_x - 25e-2", "centroid_x + 25e-2", "centroid_y - 25e-2", "centroid_y + 25e-2", 4)
_TWINS = """
SELECT scene_id, component AS group_ord, count(*) AS n, max(CASE WHEN nth = 1 THEN osm_id END) AS kept, max(height_m) AS height_m, max_by(height_source, height_m * 1e9 - ord / 1e9) AS height_source, min(min_height_m) AS min_height_m FROM (
 SELECT b.scene_id, p.component, b.osm_id, b.ord, h.height_m, h.height_source, h.min_height_m, row_number() OVER (PARTITION BY p.component ORDER BY size(b.holes) DESC, m.outline_m2 DESC, b.ord) AS nth
 FROM {parts} p JOIN {polygons} b ON b.ord = p.v JOIN {footprint_metrics} m ON m.ord = p.v JOIN {resolve_heights} h ON h.ord = b.ord) q GROUP BY scene_id, component"""


def twins(footprint_metrics: DataFrame, **_: DataFrame) -> DataFrame:
    held = cut(footprint_metrics.select("scene_id", "ord", "centroid_x", "centroid_y", "outline_m2"))  # or the folds over rings would run again in every use
    return held.sparkSession.sql(f"SELECT a.scene_id, a.ord AS a, b.ord AS b FROM {_POINTS} a JOIN {_POINTS} b ON {FIRST_CELL} AND a.ord < b.ord WHERE {_TWIN}", footprint_metrics=held)


grouped("dedupe_footprints", "polygons footprint_metrics resolve_heights", twins,
 f"SELECT a.ord AS a, b.ord AS b FROM {{footprint_metrics}} a JOIN {{footprint_metrics}} b ON a.scene_id = b.scene_id AND a.ord < b.ord WHERE {_TWIN}", _TWINS, _TWINS.replace("size(", "len("))

# footprints that share at least 25 cm2, and 2 % of the smaller one, become one outline
_MERGED = """
SELECT scene_id, component AS group_ord, count(*) AS n, max(CASE WHEN nth = 1 THEN osm_id END) AS kept, round(sum(area), 3) AS member_area_m2, max(u.outline_m2) AS outline_m2, max(u.outline_m) AS outline_m, max(height_m) AS height_m, max_by(height_source, height_m * 1e9 - ord / 1e9) AS height_source, min(min_height_m) AS min_height_m FROM (
 SELECT m.scene_id, p.component, m.osm_id, m.ord, m.area_m2 AS area, h.height_m, h.height_source, h.min_height_m, row_number() OVER (PARTITION BY p.component ORDER BY m.outline_m2 DESC, m.ord) AS nth
 FROM {parts} p JOIN {footprint_metrics} m ON m.ord = p.v JOIN {resolve_heights} h ON h.ord = m.ord) q JOIN {unions} u ON u.g = q.component GROUP BY scene_id, component"""
grouped("merge_overlaps", "polygons building_pieces footprint_metrics resolve_heights", lambda polygons, **_: overlaps(polygons).filter("shared >= greatest(25e-2, 2e-2 * least(area_a, area_b))"),
 f"SELECT a, b FROM (SELECT p.ord AS a, q.ord AS b, sum({_SHARED}) AS shared FROM {{building_pieces}} p JOIN {{building_pieces}} q ON p.scene_id = q.scene_id AND p.ord < q.ord AND p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1 GROUP BY p.ord, q.ord) s JOIN {{footprint_metrics}} m ON m.ord = s.a JOIN {{footprint_metrics}} n ON n.ord = s.b WHERE shared >= greatest(25e-2, 2e-2 * least(m.area_m2, n.area_m2))",
 _MERGED, members=lambda parts, polygons, **_: in_groups(parts, polygons), more=union_ctes("SELECT p.component AS g, x0, x1, y0, y1 FROM {building_pieces} c JOIN parts p ON p.v = c.ord"))

# areas of one layer that share area, or a corner at 1 mm, are one. Areas at a corner are linked to the first of them
_CORNERS = "SELECT scene_id, layer, ord, round(p.x, 3) AS x, round(p.y, 3) AS y FROM (SELECT scene_id, layer, ord, {explode}(ring) AS p FROM {area_rings}) c"


def touching(area_rings: DataFrame, **_: DataFrame) -> DataFrame:
    corners = _CORNERS.replace("{explode}", "explode")
    first = area_rings.sparkSession.sql(f"SELECT scene_id, min(ord) OVER (PARTITION BY scene_id, layer, x, y) AS a, ord AS b FROM ({corners}) k", area_rings=area_rings)
    return first.filter("a <> b").unionByName(overlaps(area_rings, "layer").select("scene_id", "a", "b")).distinct()


_SINGLE = f"SELECT ord, {area2('ring')} AS twice, {over('holes', lambda h: f'abs({area2(h)}) / 2')} AS hollow, {perimeter('ring')} + {over('holes', perimeter)} AS around FROM {{area_rings}}"
_DISSOLVED = """
SELECT scene_id, layer, group_ord, count(*) AS n, round(sum(area), 3) AS member_area_m2, max(outline_m2) AS outline_m2, max(outline_m) AS outline_m, max(CASE WHEN nth = 1 THEN osm_id END) AS osm_id, max(CASE WHEN nth = 1 THEN name END) AS name FROM (
 SELECT a.scene_id, a.layer, coalesce(p.component, a.ord) AS group_ord, a.osm_id, a.name, s.area, {UNION}, row_number() OVER (PARTITION BY coalesce(p.component, a.ord) ORDER BY s.area DESC, a.ord) AS nth
 FROM {area_rings} a JOIN ({SINGLE}) s ON s.ord = a.ord LEFT JOIN {parts} p ON p.v = a.ord LEFT JOIN {unions} u ON u.g = coalesce(p.component, a.ord)) q GROUP BY scene_id, layer, group_ord"""
grouped("dissolve_areas", "area_rings area_pieces", touching,
 f"SELECT DISTINCT p.ord AS a, q.ord AS b FROM {{area_pieces}} p JOIN {{area_pieces}} q ON p.scene_id = q.scene_id AND p.layer = q.layer AND p.ord < q.ord WHERE {_SHARED} > 0 UNION SELECT a.ord, b.ord FROM ({_CORNERS.replace('{explode}', 'unnest')}) a JOIN ({_CORNERS.replace('{explode}', 'unnest')}) b ON a.scene_id = b.scene_id AND a.layer = b.layer AND a.x = b.x AND a.y = b.y AND a.ord < b.ord",
 _DISSOLVED.replace("{SINGLE}", f"SELECT ord, abs(twice) / 2 - hollow AS area, around FROM ({_SINGLE}) m").replace("{UNION}", "coalesce(u.outline_m2, round(s.area, 3)) AS outline_m2, coalesce(u.outline_m, round(s.around, 3)) AS outline_m"),
 _DISSOLVED.replace("{SINGLE}", "SELECT ord, sum((x1 - x0) * (y1 - y0)) AS area FROM {area_pieces} m GROUP BY ord").replace("{UNION}", "u.outline_m2, u.outline_m"),
 members=lambda parts, area_rings, **_: in_groups(parts, area_rings), more=union_ctes("SELECT coalesce(p.component, c.ord) AS g, x0, x1, y0, y1 FROM {area_pieces} c LEFT JOIN parts p ON p.v = c.ord"))

#: Buildings closer than this on the ground become one block; one in a courtyard by its distance from the walls.
MIN_GAP = 4
grouped("merge_blocks", "polygons building_pieces", lambda polygons, **_: close_pairs(polygons, MIN_GAP),
 f"SELECT p.ord AS a, q.ord AS b FROM {{building_pieces}} p JOIN {{building_pieces}} q ON p.scene_id = q.scene_id AND p.ord < q.ord WHERE {_APART} < {MIN_GAP * MIN_GAP} GROUP BY p.ord, q.ord", """
SELECT b.scene_id, b.ord, b.osm_id, coalesce(p.component, b.ord) AS block, count(*) OVER (PARTITION BY coalesce(p.component, b.ord)) AS merged FROM {polygons} b LEFT JOIN {parts} p ON p.v = b.ord""")  # fmt: skip

# area-weighted 80th percentile of the heights of a block's members that are no heroes; members of 1.5 times it, and
# heroes above it, stand as rows of their own, other heroes are buried
operator("block_heights", "merge_blocks buildings resolve_heights hero_scores", """
WITH m AS (SELECT k.scene_id, k.block, k.ord, b.w * b.d AS weight, h.height_m, s.place <= 12 AS hero FROM {merge_blocks} k JOIN {buildings} b ON b.ord = k.ord JOIN {resolve_heights} h ON h.ord = k.ord JOIN {hero_scores} s ON s.scene_id = k.scene_id AND s.osm_id = k.osm_id),
 cum AS (SELECT block, height_m, sum(weight) OVER (PARTITION BY block ORDER BY height_m, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw, sum(weight) OVER (PARTITION BY block) AS tw FROM m WHERE NOT hero),
 level AS (SELECT block, min(CASE WHEN cw >= 8e-1 * tw - 1e-12 THEN height_m END) AS block_height FROM cum GROUP BY block)
SELECT m.scene_id, m.block, count(*) AS n, max(l.block_height) AS block_height, count_if(NOT hero AND coalesce(m.height_m > 15e-1 * l.block_height, false)) AS stacked,
 count_if(hero AND (l.block_height IS NULL OR m.height_m > l.block_height)) AS heroes, count_if(hero AND coalesce(m.height_m <= l.block_height, false)) AS buried
FROM m LEFT JOIN level l ON l.block = m.block GROUP BY m.scene_id, m.block""", merged="merge_blocks buildings resolve_heights hero_scores")  # fmt: skip

# a street is all ways of one name in a scene (a way without a name is one of its own); parts are pieces inside the crop,
# chains are groups of ways with equal end points
_ENDS = "SELECT scene_id, osm_id, min_by(x, seq) AS xa, min_by(y, seq) AS ya, max_by(x, seq) AS xb, max_by(y, seq) AS yb FROM {road_vertices} GROUP BY scene_id, osm_id"
_WAY = "CAST(substr(osm_id, 2) AS BIGINT)"
_AT = f"SELECT e.scene_id, coalesce(r.name, e.osm_id) AS street, CAST(substr(e.osm_id, 2) AS BIGINT) AS way, x, y FROM (SELECT scene_id, osm_id, xa AS x, ya AS y FROM ({_ENDS}) s UNION SELECT scene_id, osm_id, xb, yb FROM ({_ENDS}) s) e JOIN {{road_widths}} r ON r.osm_id = e.osm_id"
_JOINS = f"SELECT DISTINCT a.scene_id, a.way AS a, b.way AS b FROM ({_AT}) a JOIN ({_AT}) b ON a.scene_id = b.scene_id AND a.street = b.street AND a.x = b.x AND a.y = b.y AND a.way < b.way"
grouped("street_summary", "road_vertices line_lengths crop_lines road_widths", _JOINS, _JOINS, f"""
SELECT r.scene_id, coalesce(r.name, r.osm_id) AS street, max(r.name) AS name, count(*) AS n_ways, CAST(coalesce(sum(c.parts), 0) AS BIGINT) AS parts, round(sum(l.length_m), 3) AS length_m, max(r.width_m) AS widest_m, max_by(r.class, r.width_m * 1e9 - {_WAY.replace('osm_id', 'r.osm_id')}) AS class,
 count(DISTINCT coalesce(p.component, {_WAY.replace('osm_id', 'r.osm_id')})) AS chains
FROM {{road_widths}} r JOIN {{line_lengths}} l ON l.osm_id = r.osm_id LEFT JOIN (SELECT osm_id, count(*) AS parts FROM {{crop_lines}} GROUP BY osm_id) c ON c.osm_id = r.osm_id
LEFT JOIN {{parts}} p ON p.v = {_WAY.replace('osm_id', 'r.osm_id')} GROUP BY r.scene_id, coalesce(r.name, r.osm_id)""")  # fmt: skip
