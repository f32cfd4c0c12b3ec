"""Terrain rasters: tiles to fetch, resampling, smoothing, heights under features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrid.columns import forward, inverse, meridian, zone
from citygrid.lineage import cut
from citygrid.operators import operator, planned

# fixed values of the tile scheme
MIN_ZOOM, MAX_ZOOM, SAMPLE_M, ACROSS, EQUATOR, MAX_TILES, LAST_LAT = 12, 14, 30.0, 64, 156543.03392804097, 36, 85.0511287798


@planned("terrain_tile_cover", "requests")
def terrain_tile_cover(requests: DataFrame) -> DataFrame:
    """Zoom and tiles (x wrapped) that hold the corners of each request's turned square: the
    coarsest zoom whose pixels are as fine as asked; none if there would be more than ``MAX_TILES``."""
    wanted = f"least({SAMPLE_M}, 2 * radius_m / {ACROSS})"
    pixel = lambda z: f"{EQUATOR} * cos(radians(lat)) / {2**z}"
    zoom = "CASE " + " ".join(f"WHEN {pixel(z)} <= {wanted} THEN {z}" for z in range(MIN_ZOOM, MAX_ZOOM + 1)) + f" ELSE {MAX_ZOOM} END"
    df = requests.withColumn("zoom", F.expr(zoom)).withColumn("_m", F.expr(meridian(zone("lon")))).withColumn("_turn", F.expr("radians(pmod(rotation_deg, 360e0))"))
    df = df.withColumn("_c", F.expr(f"{forward('array(named_struct(\"lat\", lat, \"lon\", lon))', '_m')}[0]"))
    square = "transform(array(named_struct('e', -1, 'n', -1), named_struct('e', -1, 'n', 1), named_struct('e', 1, 'n', -1), named_struct('e', 1, 'n', 1)), q -> named_struct('x', _c.x + radius_m * (q.e * cos(_turn) + q.n * sin(_turn)), 'y', _c.y + radius_m * (q.n * cos(_turn) - q.e * sin(_turn))))"
    df = df.withColumn("_ll", F.expr(inverse(square, "_m"))).withColumn("_span", F.expr("CAST(pow(2, zoom) AS BIGINT)"))
    phi = f"radians(greatest(-{LAST_LAT}, least({LAST_LAT}, p.lat)))"
    tiles = f"transform(_ll, p -> named_struct('x', CAST(floor((p.lon + 180) / 360 * _span) AS BIGINT), 'y', CAST(floor((1 - ln(tan({phi}) + 1 / cos({phi})) / pi()) / 2 * _span) AS BIGINT)))"
    df = df.withColumn("_t", F.expr(tiles))
    df = df.withColumn("_x", F.expr("sequence(array_min(transform(_t, t -> t.x)), array_max(transform(_t, t -> t.x)))")).withColumn("_y", F.expr("filter(sequence(array_min(transform(_t, t -> t.y)), array_max(transform(_t, t -> t.y))), y -> y >= 0 AND y < _span)"))
    kept = df.filter(f"size(_x) * size(_y) BETWEEN 1 AND {MAX_TILES}")
    return kept.withColumn("y", F.explode("_y")).select("scene_id", "zoom", F.explode(F.expr("transform(_x, x -> pmod(x, _span))")).alias("x"), "y")


_AT = "{a}_from + ({a}_to - {a}_from) * {i} / CAST(n - 1 AS DOUBLE) - 5e-1"
_CLIP = "CAST(greatest(0, least({side} - 1, floor({at}){more})) AS BIGINT)"


@planned("resample_grid", "pixels terrain_windows", f"""
WITH px AS (SELECT p.scene_id, tx * tile_px + px AS x, ty * tile_px + py AS y, r * 256 + g + b / 256e0 - 32768 AS z FROM {{pixels}} p JOIN {{terrain_windows}} w ON w.scene_id = p.scene_id),
 ij AS (SELECT *, unnest(range(0, n)) AS j FROM (SELECT *, unnest(range(0, n)) AS i FROM {{terrain_windows}}) q),
 places AS (SELECT *, {_AT.format(a="x", i="i")} AS ax, {_AT.format(a="y", i="j")} AS ay FROM ij),
 s AS (SELECT scene_id, n, i, j, {_CLIP.format(side="cols * tile_px", at="ax", more="")} AS x0, {_CLIP.format(side="cols * tile_px", at="ax", more=" + 1")} AS x1, {_CLIP.format(side="rws * tile_px", at="ay", more="")} AS y0, {_CLIP.format(side="rws * tile_px", at="ay", more=" + 1")} AS y1, ax - floor(ax) AS fx, ay - floor(ay) AS fy FROM places),
 v AS (SELECT s.scene_id, s.i, s.j, (a.z * (1 - fx) + b.z * fx) * (1 - fy) + (c.z * (1 - fx) + d.z * fx) * fy AS z FROM s
  LEFT JOIN px a ON a.scene_id = s.scene_id AND a.x = s.x0 AND a.y = s.y0 LEFT JOIN px b ON b.scene_id = s.scene_id AND b.x = s.x1 AND b.y = s.y0
  LEFT JOIN px c ON c.scene_id = s.scene_id AND c.x = s.x0 AND c.y = s.y1 LEFT JOIN px d ON d.scene_id = s.scene_id AND d.x = s.x1 AND d.y = s.y1),
 w AS (SELECT scene_id, min(z) AS low, max(z) - min(z) AS range_m FROM v GROUP BY scene_id HAVING count(z) = count(*))
SELECT v.scene_id, v.i, v.j, round(v.z - w.low, 4) AS z, round(w.range_m, 4) AS range_m FROM v JOIN w ON w.scene_id = v.scene_id""")
def resample_grid(pixels: DataFrame, terrain_windows: DataFrame) -> DataFrame:
    """n by n samples of each scene between its pixels, over the borders of tiles; heights are above the lowest.

    ``terrain_windows`` (scene_id, n, tile_px, cols, rws, x_from, x_to, y_from, y_to): tiles of a
    scene, and where its first and last samples lie, in pixels. Pixel centres lie at halves,
    the outermost pixels go on. Each tile gets the first column, row and corner pixel of its
    neighbours to the right and below, and works out the samples that begin in it. A scene
    with a sample that lacks any of its four pixels gives nothing.
    """
    spark = pixels.sparkSession
    # a pixel goes to its tile and, as its column or row number tile_px, to those before it
    given = spark.sql(
        """SELECT w.*, p.tx + dx AS tx, p.ty + dy AS ty, CAST(p.px - dx * w.tile_px AS INT) AS px, CAST(p.py - dy * w.tile_px AS INT) AS py, p.r * 256 + p.g + p.b / 256e0 - 32768 AS z
 FROM {pixels} p JOIN {windows} w ON w.scene_id = p.scene_id LATERAL VIEW explode(CASE WHEN p.px = 0 THEN array(0, -1) ELSE array(0) END) a AS dx LATERAL VIEW explode(CASE WHEN p.py = 0 THEN array(0, -1) ELSE array(0) END) b AS dy WHERE p.tx + dx >= 0 AND p.ty + dy >= 0""",
        pixels=pixels, windows=terrain_windows,
    )

    def axis(first: float, last: float, n: int, side: int, size: int, tile: int):
        """Of the samples that begin in a tile: number, both pixels within the tile, share of the second."""
        at = first + (last - first) * np.arange(n) / float(n - 1) - 0.5
        low = np.floor(at)
        p, q = (np.clip(low + k, 0, side - 1).astype(int) for k in (0, 1))
        own = np.flatnonzero(p // size == tile)
        return own, p[own] - tile * size, q[own] - tile * size, (at - low)[own]

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf.iloc[0]
        size = int(w["tile_px"])
        z = np.full((size + 1, size + 1), np.nan)
        z[pdf["py"], pdf["px"]] = pdf["z"]
        i, x0, x1, fx = axis(w["x_from"], w["x_to"], int(w["n"]), int(w["cols"]) * size, size, int(w["tx"]))
        j, y0, y1, fy = axis(w["y_from"], w["y_to"], int(w["n"]), int(w["rws"]) * size, size, int(w["ty"]))
        fy = fy[:, None]
        value = (z[np.ix_(y0, x0)] * (1 - fx) + z[np.ix_(y0, x1)] * fx) * (1 - fy) + (z[np.ix_(y1, x0)] * (1 - fx) + z[np.ix_(y1, x1)] * fx) * fy
        # a pixel of no weight counts as missing too, if it is
        return pd.DataFrame({"scene_id": w["scene_id"], "n": w["n"], "i": np.tile(i, len(j)), "j": np.repeat(j, len(i)), "z": value.ravel()})

    samples = cut(given.groupBy("scene_id", "tx", "ty").applyInPandas(sample, "scene_id long, n int, i int, j int, z double").filter("z IS NOT NULL AND NOT isnan(z)"))
    return spark.sql("SELECT v.scene_id, v.i, v.j, round(v.z - w.low, 4) AS z, round(w.range_m, 4) AS range_m FROM {v} v JOIN (SELECT scene_id, min(z) AS low, max(z) - min(z) AS range_m FROM {v} GROUP BY scene_id HAVING count(*) = max(n) * max(n)) w ON w.scene_id = v.scene_id", v=samples)


PASSES = 2


def blurred(side: str, along: str, across: str) -> str:
    """A box of three along one axis; the edge counts itself again. A window holds one line of one scene."""
    w = f"(PARTITION BY scene_id, {across} ORDER BY {along})"
    return f"(SELECT scene_id, r, c, (coalesce(lag(z) OVER {w}, z) + z + coalesce(lead(z) OVER {w}, z)) / 3 AS z FROM {side} {along}{across})"


def smooth(side: str, passes: int = PASSES) -> str:
    """0 to 5 passes by row, then by column."""
    for _ in range(passes):
        side = blurred(blurred(side, "c", "r"), "r", "c")
    return side


operator("smooth_grid", "grid", f"SELECT g.scene_id, r, c, round(z - low, 6) AS z FROM {smooth('{grid}')} g JOIN (SELECT scene_id, min(z) AS low FROM {smooth('{grid}')} m GROUP BY scene_id) l ON l.scene_id = g.scene_id")

# the lowest and highest ground under a footprint's corners; the scene's raster covers a square of half side EXTENT. Each
# square of the raster is one row with its four heights, so a corner meets one row
EXTENT = "900e0"
_SPOTS = f"""
WITH ext AS (SELECT scene_id, max(r) AS rows_, max(c) AS cols FROM {{grid}} GROUP BY scene_id),
 p AS (SELECT b.scene_id, b.ord, greatest(0e0, least(cols, (v.x + {EXTENT}) / (2 * {EXTENT}) * cols)) AS x, greatest(0e0, least(rows_, (v.y + {EXTENT}) / (2 * {EXTENT}) * rows_)) AS y, cols, rows_ FROM (SELECT scene_id, ord, SPREAD(ring) AS v FROM {{polygons}}) b JOIN ext e ON e.scene_id = b.scene_id),
 q AS (SELECT *, CAST(least(cols - 1, floor(x)) AS BIGINT) AS c0, CAST(least(rows_ - 1, floor(y)) AS BIGINT) AS r0, x - least(cols - 1, floor(x)) AS fc, y - least(rows_ - 1, floor(y)) AS fr FROM p)"""
_LIFT = "SELECT scene_id, ord, round(min(h), 6) AS lift, round(max(h) - min(h), 6) AS fall FROM ({}) k GROUP BY scene_id, ord"
_SQUARES = "(SELECT scene_id, r, c, z AS za, zb, lead(z) OVER (PARTITION BY scene_id, c ORDER BY r) AS zc, lead(zb) OVER (PARTITION BY scene_id, c ORDER BY r) AS zd FROM (SELECT *, lead(z) OVER (PARTITION BY scene_id, r ORDER BY c) AS zb FROM {grid}) s1)"
_BY_SQUARES = f"SELECT q.scene_id, q.ord, (g.za * (1 - fc) + g.zb * fc) * (1 - fr) + (g.zc * (1 - fc) + g.zd * fc) * fr AS h FROM q JOIN {_SQUARES} g ON g.scene_id = q.scene_id AND g.r = q.r0 AND g.c = q.c0"
_BY_JOINS = "SELECT q.scene_id, q.ord, (a.z * (1 - fc) + b.z * fc) * (1 - fr) + (c.z * (1 - fc) + d.z * fc) * fr AS h FROM q JOIN " + " JOIN ".join(f"{{grid}} {n} ON {n}.scene_id = q.scene_id AND {n}.r = q.r0 + {dr} AND {n}.c = q.c0 + {dc}" for n, dr, dc in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1)))
operator("terrain_under_features", "grid polygons", _SPOTS.replace("SPREAD", "explode") + _LIFT.format(_BY_SQUARES), _SPOTS.replace("SPREAD", "unnest") + _LIFT.format(_BY_JOINS))
