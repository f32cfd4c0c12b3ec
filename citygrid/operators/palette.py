"""Colour analytics: tints, contrast, slots, colour changes by height."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrid.lineage import Shelf
from citygrid.operators import operator, planned


def rgb(color: str, spark: bool, k: int) -> str:
    """The k-th byte of '#RRGGBB'."""
    digits = f"substr({color}, {2 + 2 * k}, 2)"
    return f"CAST(conv({digits}, 16, 10) AS DOUBLE)" if spark else f"CAST(CAST(concat('0x', {digits}) AS BIGINT) AS DOUBLE)"


def lab(color: str, spark: bool) -> list[str]:
    """CIE L*, a*, b* of a colour; the matrix, the white and the curve are fixed values."""
    lin = [f"(CASE WHEN {c} / 255 <= 0.04045e0 THEN {c} / 255 / 12.92e0 ELSE pow(({c} / 255 + 0.055e0) / 1.055e0, 2.4e0) END)" for c in (rgb(color, spark, k) for k in range(3))]
    rows = ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.715152, 0.072175, 1.0), (0.0193339, 0.119192, 0.9503041, 1.08883))
    xyz = [f"(({' + '.join(f'{v} * CAST({m}e0 AS DOUBLE)' for v, m in zip(lin, row))}) / {row[3]}e0)" for row in rows]
    x, y, z = (f"(CASE WHEN {t} > 0.008856e0 THEN pow({t}, 1e0 / 3) ELSE 7.787e0 * {t} + 16e0 / 116 END)" for t in xyz)
    return [f"116 * {y} - 16", f"500 * ({x} - {y})", f"200 * ({y} - {z})"]


def labs(table: str, spark: bool) -> str:
    """Colours with their L, a, b rounded to 1e-6, so that both engines order distances alike."""
    return f"SELECT color, {', '.join(f'round({e}, 6) AS {n}' for e, n in zip(lab('color', spark), ('la', 'lb', 'lc')))} FROM (SELECT DISTINCT color FROM {table}) q"


_FAR = "round(sqrt(({p}.la - {q}.la) * ({p}.la - {q}.la) + ({p}.lb - {q}.lb) * ({p}.lb - {q}.lb) + ({p}.lc - {q}.lc) * ({p}.lc - {q}.lc)), 4)"
CLASH = 12


def contrast(spark: bool) -> str:
    """Neighbouring regions of a design on different slots whose colours are closer than
    ``CLASH``, and the swatch nearest to the first that is far enough from the second."""
    return f"""
WITH lab AS ({labs("(SELECT color FROM {regions} UNION SELECT color FROM {swatches}) c", spark)}),
 near AS (SELECT a.design_id, a.region AS region_a, b.region AS region_b, a.color AS color_a, b.color AS color_b, {_FAR.format(p="p", q="q")} AS distance FROM {{regions}} a JOIN {{regions}} b ON b.design_id = a.design_id AND b.nth = a.nth + 1 AND b.slot <> a.slot JOIN lab p ON p.color = a.color JOIN lab q ON q.color = b.color),
 help AS (SELECT n.design_id, n.region_a, s.color, row_number() OVER (PARTITION BY n.design_id, n.region_a ORDER BY {_FAR.format(p="l", q="p")}, s.nth) AS place FROM near n CROSS JOIN {{swatches}} s JOIN lab l ON l.color = s.color JOIN lab p ON p.color = n.color_a JOIN lab q ON q.color = n.color_b WHERE n.distance < {CLASH} AND {_FAR.format(p="l", q="q")} >= {CLASH})
SELECT n.design_id, n.region_a, n.region_b, n.color_a, n.color_b, n.distance, h.color AS suggestion FROM near n LEFT JOIN help h ON h.design_id = n.design_id AND h.region_a = n.region_a AND h.place = 1 WHERE n.distance < {CLASH}"""


operator("contrast_issues", "regions swatches", contrast(True), contrast(False))

# regions on one slot print in the colour of the first; the others lose theirs. Slots over the printer's are counted
_LOSERS = """
WITH w AS (SELECT *, min(nth) OVER (PARTITION BY design_id, slot) AS first FROM {regions}),
 f AS (SELECT r.design_id, r.slot, r.color AS winner FROM w r WHERE r.nth = r.first)
SELECT w.design_id, w.slot, f.winner, count(DISTINCT w.color) AS n_colours, LIST AS losers, max(CASE WHEN w.slot > p.slots THEN 1 ELSE 0 END) = 1 AS over_capacity
FROM w JOIN f ON f.design_id = w.design_id AND f.slot = w.slot JOIN {designs} d ON d.design_id = w.design_id JOIN {printers} p ON p.printer_ix = d.printer_ix GROUP BY w.design_id, w.slot, f.winner HAVING count(DISTINCT w.color) > 1"""
operator("slot_conflicts", "regions designs printers", _LOSERS.replace("LIST", "array_join(transform(array_sort(collect_list(CASE WHEN w.color <> f.winner THEN named_struct('nth', w.nth, 'region', w.region) END)), x -> x.region), ',')"), _LOSERS.replace("LIST", "string_agg(CASE WHEN w.color <> f.winner THEN w.region END, ',' ORDER BY w.nth)"))


@planned("merge_slots", "regions designs printers")
def merge_slots(regions: DataFrame, designs: DataFrame, printers: DataFrame, most: int = 16) -> DataFrame:
    """regions (design_id, region, nth, slot, color) -> the slot and colour of each after the two
    nearest colours of a design have been joined until its printer's slots suffice: the colour of the
    heavier cluster stays, slots are numbered by the lowest they had. All designs go on at once, a
    round a join, at most ``most`` - 1 rounds."""
    spark = regions.sparkSession
    shelf = Shelf(spark)
    target = designs.join(printers, "printer_ix").select("design_id", F.greatest("slots", F.lit(1)).alias("target"))
    first = regions.groupBy("design_id", "slot").agg(F.min_by("color", "nth").alias("color"), F.count("*").alias("weight"))
    held = shelf.put("held0", first.join(target, "design_id").select("design_id", F.col("slot").alias("cluster"), F.col("slot").cast("long").alias("place"), "color", "weight", F.array("slot").alias("slots"), "target"))
    for r in range(1, most):
        size = held.groupBy("design_id").agg(F.count("*").alias("n"), F.max("place").alias("last"))
        over = held.join(size, "design_id").filter("n > target")
        if over.isEmpty():
            break
        over = shelf.put(f"over{r}", over)
        names = spark.sql(labs("{t}", True), t=over)
        side = lambda c: over.select("design_id", "last", *[F.col(x).alias(f"{x}_{c}") for x in ("cluster", "place", "color", "weight", "slots")]).join(names.select(F.col("color").alias(f"color_{c}"), *[F.col(x).alias(f"{x}_{c}") for x in ("la", "lb", "lc")]), f"color_{c}")
        pairs = side("a").join(side("b").drop("last"), "design_id").filter("place_a < place_b")
        apart = F.expr("round(sqrt((la_a - la_b) * (la_a - la_b) + (lb_a - lb_b) * (lb_a - lb_b) + (lc_a - lc_b) * (lc_a - lc_b)), 4)")
        best = pairs.groupBy("design_id").agg(F.min_by(F.struct("last", "cluster_a", "cluster_b", "color_a", "color_b", "weight_a", "weight_b", "slots_a", "slots_b"), F.struct(apart.alias("d"), "place_a", "place_b")).alias("p")).select("design_id", "p.*")
        best = shelf.put(f"best{r}", best)
        merged = best.join(target, "design_id").select("design_id", F.least("cluster_a", "cluster_b").alias("cluster"), (F.col("last") + 1).alias("place"), F.expr("CASE WHEN weight_a >= weight_b THEN color_a ELSE color_b END").alias("color"), (F.col("weight_a") + F.col("weight_b")).alias("weight"), F.concat("slots_a", "slots_b").alias("slots"), "target")
        gone = best.select("design_id", F.explode(F.array("cluster_a", "cluster_b")).alias("cluster"))
        held = shelf.put(f"held{r}", held.join(gone, ["design_id", "cluster"], "left_anti").select(*merged.columns).unionByName(merged))
    numbered = spark.sql("SELECT design_id, color, slots, row_number() OVER (PARTITION BY design_id ORDER BY array_min(slots)) AS new_slot, count(*) OVER (PARTITION BY design_id) AS n FROM {h}", h=held)
    return regions.join(numbered.select("design_id", F.col("color").alias("new_color"), "new_slot", F.explode("slots").alias("slot")), ["design_id", "slot"]).select("design_id", "region", "slot", "new_slot", "new_color")


# fixed values: offset and prime of the hash. Draws of a building are hashes of seed|id:h and seed|id:l over 2**32 - 1
def draw(text: str, spark: bool) -> str:
    if spark:
        return f"(aggregate(transform(split({text}, ''), c -> CAST(ascii(c) AS BIGINT)), 2166136261L, (h, c) -> (h ^ c) * 16777619L % 4294967296L) / 4294967295e0)"
    return f"(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: xor(h, c) * 16777619 % 4294967296) / 4294967295e0)"


HUE, LIGHT, MATERIALS = 12, "0.12e0", 32


def tints(spark: bool) -> str:
    """The design's base colour, shifted for each building in hue and lightness; a tint of its
    own wins. At most ``MATERIALS`` colours a design: buckets of equal count by luminance, whose
    middle stands for all."""
    hue = "CASE WHEN t < 0 THEN t + 1 WHEN t > 1 THEN t - 1 ELSE t END"
    part = lambda t: f"(CASE WHEN {t} < 1e0 / 6 THEN p + (q - p) * 6 * {t} WHEN {t} < 5e-1 THEN q WHEN {t} < 2e0 / 3 THEN p + (q - p) * (2e0 / 3 - {t}) * 6 ELSE p END)"
    byte = lambda c: f"CAST(floor(least(1e0, greatest(0e0, round({c}, 9))) * 255 + 5e-1) AS BIGINT)"
    turn = lambda d: hue.replace("t", f"(h / 360 {d})") if d else "h / 360"
    hexa = "concat('#', " + ", ".join(f"lpad({'hex' if spark else 'to_hex'}({c}), 2, '0')" for c in ("r8", "g8", "b8")) + ")"
    return f"""
WITH base AS (SELECT d.design_id, b.osm_id, d.tint_seed AS seed, d.tint_hue AS hue, d.tint_saturation AS s, d.tint_lightness AS l FROM {{designs}} d JOIN {{buildings}} b ON b.scene_id = d.scene_id WHERE d.tinted),
 shifted AS (SELECT design_id, osm_id, s, {'pmod' if spark else ''}((hue + ({draw("concat(CAST(seed AS STRING), '|', osm_id, ':h')", spark)} * 2 - 1) * {HUE} + 360){', 360e0)' if spark else ' % 360)'} AS h, least(1e0, greatest(0e0, l + ({draw("concat(CAST(seed AS STRING), '|', osm_id, ':l')", spark)} * 2 - 1) * {LIGHT})) AS l FROM base),
 pq AS (SELECT *, CASE WHEN l < 5e-1 THEN l * (1 + s) ELSE l + s - l * s END AS q, 2 * l - CASE WHEN l < 5e-1 THEN l * (1 + s) ELSE l + s - l * s END AS p FROM shifted),
 turned AS (SELECT *, {turn("+ 1e0 / 3")} AS tr, {turn("")} AS tg, {turn("- 1e0 / 3")} AS tb FROM pq),
 bytes AS (SELECT design_id, osm_id, {byte(part("tr"))} AS r8, {byte(part("tg"))} AS g8, {byte(part("tb"))} AS b8 FROM turned),
 own AS (SELECT design_id, osm_id, color FROM (SELECT *, row_number() OVER (PARTITION BY design_id, osm_id ORDER BY ord DESC) AS back FROM {{overrides}} WHERE layer = 'building' AND color IS NOT NULL) o WHERE back = 1),
 painted AS (SELECT y.design_id, y.osm_id, upper(coalesce(o.color, {hexa})) AS color FROM bytes y LEFT JOIN own o ON o.design_id = y.design_id AND o.osm_id = y.osm_id),
 colours AS (SELECT design_id, color, count(*) AS buildings, {' + '.join(f"{m} * {rgb('color', spark, k)}" for k, m in enumerate(("0.2126e0", "0.7152e0", "0.0722e0")))} AS luminance FROM painted GROUP BY design_id, color),
 placed AS (SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY round(luminance, 6), color) - 1 AS i, count(*) OVER (PARTITION BY design_id) AS n FROM colours),
 bucketed AS (SELECT *, CAST(floor(i * least({MATERIALS}, n) / n) AS BIGINT) AS bucket FROM placed),
 sized AS (SELECT *, row_number() OVER (PARTITION BY design_id, bucket ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY design_id, bucket) AS m FROM bucketed)
SELECT design_id, bucket, max(CASE WHEN j = floor(m / 2) THEN color END) AS material, count(*) AS colours, CAST(sum(buildings) AS BIGINT) AS buildings FROM sized GROUP BY design_id, bucket"""


operator("tint_materials", "designs buildings overrides", tints(True), tints(False))

# regions as intervals of height: each elementary slice belongs to the one slot that has material there, else to the slot
# below; runs of one slot are bands, each change lies on a layer. A slot that shares a slice with another conflicts there
LAYER = "0.2e0"
_PLAN = f"""
WITH edge AS (SELECT DISTINCT design_id, z FROM (SELECT design_id, z0 AS z FROM {{regions}} UNION SELECT design_id, z1 FROM {{regions}}) e),
 slice AS (SELECT design_id, z AS a, lead(z) OVER (PARTITION BY design_id ORDER BY z) AS b FROM edge),
 own AS (SELECT s.design_id, s.a, s.b, count(DISTINCT r.slot) AS n_slots, min(r.slot) AS slot, max(r.slot) AS other FROM slice s LEFT JOIN {{regions}} r ON r.design_id = s.design_id AND r.z0 <= s.a AND r.z1 >= s.b WHERE s.b IS NOT NULL GROUP BY s.design_id, s.a, s.b),
 carried AS (SELECT *, coalesce(CASE WHEN n_slots = 1 THEN slot END, LAST) AS served FROM own),
 starts AS (SELECT *, CASE WHEN lag(served) OVER (PARTITION BY design_id ORDER BY a) IS NOT DISTINCT FROM served THEN 0 ELSE 1 END AS opens FROM carried),
 run AS (SELECT *, sum(opens) OVER (PARTITION BY design_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS band FROM starts)
SELECT design_id, CAST(band AS BIGINT) AS band, max(served) AS slot, min(a) AS from_mm, max(b) AS to_mm, round(ceil(round(min(a) / {LAYER}, 6)) * {LAYER}, 6) AS change_mm, count_if(n_slots > 1) AS conflicts, count_if(n_slots > 1) = 0 AS separable FROM run GROUP BY design_id, band"""
_W = "(PARTITION BY design_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
operator("colour_change_plan", "regions", _PLAN.replace("LAST", f"last(CASE WHEN n_slots = 1 THEN slot END) IGNORE NULLS OVER {_W}"), _PLAN.replace("LAST", f"last_value(CASE WHEN n_slots = 1 THEN slot END IGNORE NULLS) OVER {_W}"))
