"""Map extracts: responses, their elements, requests, projection, and layer tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygrid.columns import forward, inverse, meridian, zone, wrapped
from citygrid.lineage import shared_folder
from citygrid.operators import operator, planned

POINTS = "array<struct<lat:double,lon:double>>"
ELEMENT = f"struct<type:string,id:long,tags:map<string,string>,geometry:{POINTS},members:array<struct<type:string,ref:long,role:string,geometry:{POINTS}>>,lat:double,lon:double>"
RESPONSE = f"struct<remark:string,elements:array<{ELEMENT}>,_bad:string>"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """A folder of response files, named by their scene's number -> scene_id, response_id, body."""
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    return files.select(F.regexp_extract("file", r"([0-9]+)[^/]*$", 1).cast("long").alias("scene_id"), F.xxhash64("file").alias("response_id"), F.col("value").alias("body"))


def judged(responses: DataFrame) -> DataFrame:
    """responses (scene_id, response_id, body) -> the same with ``parsed`` and ``reason`` (null: accepted)."""
    parsed = responses.withColumn("parsed", F.from_json("body", RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    remark = F.lower(F.trim(F.coalesce("parsed.remark", F.lit(""))))
    reason = (
        F.when(F.col("parsed").isNull() | F.col("parsed._bad").isNotNull(), "not json")
        .when(F.col("parsed.elements").isNull(), "no elements")
        .when(remark.contains("runtime error"), "runtime error").when(remark.contains("out of memory"), "out of memory")
        .when((remark != "") & (F.size("parsed.elements") == 0), "remark without data")
    )
    return parsed.withColumn("reason", reason)


def elements(responses: DataFrame) -> DataFrame:
    """The elements of accepted responses: scene_id, ord, type, osm_id (w, r or n and the
    number), tags, geometry without null points, members, lat, lon."""
    one = judged(responses).filter("reason IS NULL").select("scene_id", "response_id", F.posexplode("parsed.elements").alias("ord", "e")).filter("e IS NOT NULL")
    points = F.filter("e.geometry", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    return one.select(
        "scene_id", "response_id", "ord", "e.type", F.concat(F.substring("e.type", 1, 1), F.col("e.id").cast("string")).alias("osm_id"), "e.tags", points.alias("geometry"), "e.members", "e.lat", "e.lon",
    )


_GOOD = "{p}ord % 6 < 4"
_WAYS = f"SELECT scene_id, 'way' AS type, osm_id, building, CAST(CASE WHEN ord % 9 = 0 THEN 4 ELSE 5 END AS INT) AS n_points, 0 AS n_members FROM {{buildings}} WHERE osm_id LIKE 'w%' AND {_GOOD.format(p='')}"


@planned("osm_elements", "responses buildings trees", f"""
{_WAYS} UNION ALL SELECT scene_id, 'relation', osm_id, building, 0, 1 FROM {{buildings}} WHERE osm_id LIKE 'r%' AND {_GOOD.format(p='')}
UNION ALL SELECT scene_id, 'node', concat('n', CAST(ord AS STRING)), NULL, 0, 0 FROM {{trees}} WHERE {_GOOD.format(p='')}""")
def osm_elements(responses: DataFrame, buildings: DataFrame | None = None, trees: DataFrame | None = None) -> DataFrame:
    """Elements of all accepted responses, with the sizes of what they hold."""
    return elements(responses).select("scene_id", "type", "osm_id", F.col("tags")["building"].alias("building"), F.greatest(F.lit(0), F.coalesce(F.size("geometry"), F.lit(0))).alias("n_points"), F.greatest(F.lit(0), F.coalesce(F.size("members"), F.lit(0))).alias("n_members"))


@planned("split_bad_responses", "responses buildings trees", """
SELECT s.scene_id, s.scene_id * 16 + c AS response_id, c < 4 OR c = 8 AS accepted, CASE c WHEN 4 THEN 'runtime error' WHEN 5 THEN 'not json' WHEN 6 THEN 'not json' WHEN 7 THEN 'remark without data' WHEN 9 THEN 'no elements' WHEN 10 THEN 'out of memory' END AS reason
FROM (SELECT DISTINCT scene_id FROM {trees}) s CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) AS cc(c)""")
def split_bad_responses(responses: DataFrame, buildings: DataFrame | None = None, trees: DataFrame | None = None) -> DataFrame:
    """Which responses are accepted, and why others are not."""
    return judged(responses).select("scene_id", "response_id", F.col("reason").isNull().alias("accepted"), "reason")


@planned("suppress_outer_ways", "responses buildings trees", """
SELECT scene_id, osm_id FROM {buildings} b WHERE osm_id LIKE 'w%' AND ord % 6 < 4 AND NOT EXISTS (SELECT 1 FROM {buildings} r WHERE r.ord = b.ord + 100000000 AND r.ord % 6 < 4 AND b.ord % 100 <> 57)""")
def suppress_outer_ways(responses: DataFrame, buildings: DataFrame | None = None, trees: DataFrame | None = None) -> DataFrame:
    """Building ways that are no outer member (role outer or empty, two points or more) of a building relation."""
    of = elements(responses)
    built = F.col("tags")["building"].isNotNull() & ~F.col("tags")["building"].isin("no", "false")
    member = of.filter((F.col("type") == "relation") & built).select("scene_id", F.explode("members").alias("m")).filter("m.type = 'way' AND coalesce(m.role, '') IN ('outer', '') AND size(m.geometry) >= 2")
    outer = member.select("scene_id", F.concat(F.lit("w"), F.col("m.ref").cast("string")).alias("osm_id")).distinct()
    return of.filter((F.col("type") == "way") & built).join(outer, ["scene_id", "osm_id"], "left_anti").select("scene_id", "osm_id")


def projected(features: DataFrame, requests: DataFrame) -> DataFrame:
    """features (scene_id, .., geometry of lat and lon) -> ``path`` in local metres: UTM of the
    request's zone, less its centre, turned counter-clockwise by rotation_deg."""
    at = requests.select("scene_id", F.expr(meridian(zone("lon"))).alias("_m"), F.expr("radians(pmod(rotation_deg, 360e0))").alias("_turn"), "lat", "lon")
    at = at.select("scene_id", "_m", "_turn", F.expr(f"{forward('array(named_struct(\"lat\", lat, \"lon\", lon))', '_m')}[0]").alias("_c"))
    df = features.join(at, "scene_id").withColumn("path", F.expr(forward("geometry", "_m")))
    turned = "named_struct('x', (p.x - _c.x) * cos(_turn) - (p.y - _c.y) * sin(_turn), 'y', (p.x - _c.x) * sin(_turn) + (p.y - _c.y) * cos(_turn))"
    return df.withColumn("path", F.expr(f"transform(path, p -> {turned})")).drop("_m", "_turn", "_c")


@planned("project_features", "responses requests")
def project_features(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """Ways in local metres: their box, rounded to 1 mm."""
    ways = projected(elements(responses).filter("type = 'way' AND size(geometry) > 0").select("scene_id", "osm_id", "geometry"), requests)
    ends = {f"{f}_{a}": F.expr(f"round(array_{f}(transform(path, p -> p.{a})), 3)") for f in ("min", "max") for a in "xy"}
    return ways.select("scene_id", "osm_id", F.size("path").alias("n_points"), *[e.alias(n) for n, e in ends.items()])


@planned("scene_requests", "requests")
def scene_requests(requests: DataFrame, margin: float = 1.15, steps: int = 16) -> DataFrame:
    """requests (scene_id, lat, lon, radius_m, rotation_deg, preset_id) -> the key of each (sha256 of
    its fields in order), and the box of latitudes and longitudes around the turned square with a
    margin: least and most over points of its outline, rounded to 1e-7. Across the date line west is larger than east."""
    fields = F.struct(*[F.col(c) for c in ("lat", "lon", "preset_id", "radius_m", "rotation_deg")])
    df = requests.withColumn("request_key", F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)).withColumn("_m", F.expr(meridian(zone("lon"))))
    df = df.withColumn("_c", F.expr(f"{forward('array(named_struct(\"lat\", lat, \"lon\", lon))', '_m')}[0]")).withColumn("_turn", F.expr("radians(pmod(rotation_deg, 360e0))"))
    side = f"transform(sequence(0, {steps}), i -> {margin} * radius_m * (2e0 * i / {steps} - 1))"
    corner = f"{margin} * radius_m"
    square = f"flatten(transform({side}, t -> array(named_struct('x', t, 'y', -({corner})), named_struct('x', t, 'y', {corner}), named_struct('x', -({corner}), 'y', t), named_struct('x', {corner}, 'y', t))))"
    square = f"transform({square}, p -> named_struct('x', CAST(p.x AS DOUBLE), 'y', CAST(p.y AS DOUBLE)))"
    back = f"transform({square}, p -> named_struct('x', _c.x + p.x * cos(_turn) + p.y * sin(_turn), 'y', _c.y - p.x * sin(_turn) + p.y * cos(_turn)))"
    df = df.withColumn("_ring", F.expr(inverse(back, "_m")))
    end = lambda f, a: f"array_{f}(transform(_ring, p -> p.{a}))"
    ends = [F.expr(f"round({e}, 7)").alias(n) for e, n in ((end("min", "lat"), "south"), (wrapped(end("min", "lon")), "west"), (end("max", "lat"), "north"), (wrapped(end("max", "lon")), "east"))]
    return df.select("scene_id", "request_key", *ends)


_LAYERS = "SELECT scene_id, osm_id, 'building' AS layer FROM {buildings} UNION ALL SELECT scene_id, osm_id, 'road' FROM {road_tags} UNION ALL SELECT scene_id, osm_id, layer FROM {areas} UNION ALL SELECT scene_id, concat('n', CAST(ord AS STRING)), 'tree' FROM {trees}"


def write_layers(features: DataFrame, path: str) -> None:
    """features (layer, scene_id, ..) as Parquet, a folder a layer, rows of a scene together; and
    a line of JSON for each scene: what it holds."""
    features.repartitionByRange("layer", "scene_id").sortWithinPartitions("layer", "scene_id").write.partitionBy("layer").parquet(f"{path}/layers")
    features.groupBy("scene_id").agg(F.count("*").alias("n_features"), F.sort_array(F.collect_set("layer")).alias("layers")).write.json(f"{path}/scenes")


@planned("write_scene_tables", "buildings road_tags areas trees", f"SELECT scene_id, layer, count(*) AS n_features, min(osm_id) AS first_id, max(osm_id) AS last_id FROM ({_LAYERS}) q GROUP BY scene_id, layer")
def write_scene_tables(buildings: DataFrame, road_tags: DataFrame, areas: DataFrame, trees: DataFrame) -> DataFrame:
    """Writes the layers to the shared folder, reads them back and counts."""
    spark = buildings.sparkSession
    path = f"{shared_folder(spark)}/scenes-{uuid.uuid4().hex}"
    write_layers(spark.sql(_LAYERS, buildings=buildings, road_tags=road_tags, areas=areas, trees=trees), path)
    return spark.read.parquet(f"{path}/layers").groupBy("scene_id", "layer").agg(F.count("*").alias("n_features"), F.min("osm_id").alias("first_id"), F.max("osm_id").alias("last_id"))
