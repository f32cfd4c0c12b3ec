"""Colours, bands and scale bars of designs."""

from citygrid.operators import operator

operator("height_bands", "resolve_heights", """
SELECT scene_id, band, count(*) AS n, min(height_m) AS low_m, max(height_m) AS high_m FROM (
 SELECT scene_id, height_m, CAST(floor((row_number() OVER (PARTITION BY scene_id ORDER BY height_m, ord) - 1) * 8 / count(*) OVER (PARTITION BY scene_id)) AS BIGINT) AS band FROM {resolve_heights}) q GROUP BY scene_id, band""")  # fmt: skip

operator("equal_width_bands", "resolve_heights", """
SELECT scene_id, band, count(*) AS n FROM (SELECT scene_id, CAST(least(7, floor(height_m / max(height_m) OVER (PARTITION BY scene_id) * 8)) AS BIGINT) AS band FROM {resolve_heights}) q GROUP BY scene_id, band""")  # fmt: skip

operator("scale_bar", "designs", """
WITH steps AS (SELECT CAST(m * pow(10e0, k) AS DOUBLE) AS metres FROM (VALUES (1), (2), (5)) AS mm(m) CROSS JOIN (VALUES (-1), (0), (1), (2), (3), (4), (5), (6), (7)) AS kk(k)),
 s AS (SELECT design_id, (plate_mm - CASE WHEN frame THEN 12 ELSE 0 END) / (2 * radius_m) AS scale FROM {designs}),
 t AS (SELECT design_id, metres, metres * scale AS mm, metres * scale BETWEEN 15 AND 40 AS fits, least(abs(metres * scale - 15), abs(metres * scale - 40)) AS off FROM s CROSS JOIN steps)
SELECT design_id, coalesce(max(CASE WHEN fits THEN metres END), min_by(metres, off)) AS metres FROM t GROUP BY design_id""")  # fmt: skip
