"""Places, text and design parameters."""

from citygrid.operators import operator

#: A feature as a geocoder sends it; what else it holds is not read.
FEATURE = "type STRING, geometry STRUCT<coordinates: ARRAY<DOUBLE>>, properties STRUCT<osm_type: STRING, osm_id: BIGINT, osm_key: STRING, osm_value: STRING, type: STRING, name: STRING, housenumber: STRING, street: STRING, district: STRING, city: STRING, county: STRING, state: STRING, country: STRING>, address STRUCT<city: STRING, town: STRING, village: STRING, municipality: STRING, county: STRING, state: STRING, country: STRING, neighbourhood: STRING, suburb: STRING, quarter: STRING>"
_NAMES = "osm_key osm_value type name housenumber street district city county state country".split()
_ADDRESS = "city town village municipality county state country neighbourhood suburb quarter".split()
_text = lambda v: f"nullif(trim({v}), '')"
_READ = f"SELECT place_ord, f.geometry.coordinates AS spot, f.properties.osm_type, f.properties.osm_id, {', '.join(f'{_text(f"f.properties.{n}")} AS {n}' for n in _NAMES)}, {', '.join(f'{_text(f"f.address.{n}")} AS a_{n}' for n in _ADDRESS)} FROM (SELECT place_ord, from_json(feature, '{FEATURE}') AS f FROM {{place_features}}) j"
_PLAIN_READ = f"SELECT place_ord, CASE WHEN json_type(feature, '$.geometry.coordinates') = 'ARRAY' THEN CAST(json_extract(feature, '$.geometry.coordinates') AS DOUBLE[]) END AS spot, json_extract_string(feature, '$.properties.osm_type') AS osm_type, CAST(json_extract(feature, '$.properties.osm_id') AS BIGINT) AS osm_id, {', '.join(f"{_text(f"json_extract_string(feature, '$.properties.{n}')")} AS {n}" for n in _NAMES)}, {', '.join(f"{_text(f"json_extract_string(feature, '$.address.{n}')")} AS a_{n}" for n in _ADDRESS)} FROM {{place_features}} WHERE json_valid(feature)"
# fixed values: kinds by key and value, else by type; radii by kind
_KIND = """CASE lower(osm_key) WHEN 'highway' THEN 'road' WHEN 'building' THEN 'building' WHEN 'amenity' THEN 'amenity' WHEN 'shop' THEN 'amenity' WHEN 'tourism' THEN 'amenity' WHEN 'leisure' THEN 'amenity'
 WHEN 'place' THEN CASE lower(osm_value) WHEN 'city' THEN 'city' WHEN 'town' THEN 'town' WHEN 'borough' THEN 'suburb' WHEN 'suburb' THEN 'suburb' WHEN 'neighbourhood' THEN 'neighbourhood' WHEN 'quarter' THEN 'neighbourhood' WHEN 'house' THEN 'house' WHEN 'houses' THEN 'house' WHEN 'village' THEN 'locality' WHEN 'hamlet' THEN 'locality' WHEN 'locality' THEN 'locality' WHEN 'county' THEN 'region' WHEN 'state' THEN 'region' WHEN 'region' THEN 'region' WHEN 'country' THEN 'region' END
 WHEN 'boundary' THEN CASE WHEN lower(osm_value) = 'administrative' THEN 'region' END WHEN 'landuse' THEN CASE WHEN lower(osm_value) = 'administrative' THEN 'region' END END"""
_TYPE = "CASE lower(type) WHEN 'street' THEN 'road' WHEN 'house' THEN 'house' WHEN 'city' THEN 'city' WHEN 'district' THEN 'suburb' WHEN 'locality' THEN 'locality' WHEN 'county' THEN 'region' WHEN 'state' THEN 'region' WHEN 'country' THEN 'region' ELSE 'place' END"
_PARTS = ["street", "district", "city", "county", "state", "country"]
_fresh = lambda k: " AND ".join(f"lower({_PARTS[k]}) <> coalesce(lower({p}), '')" for p in ["title", *_PARTS[:k]])
_PLACES = f"""
WITH f AS (READ), named AS (SELECT *, spot[FIRST] AS lon, spot[SECOND] AS lat, coalesce(name, CASE WHEN housenumber IS NOT NULL THEN concat(housenumber, ' ', street) ELSE street END, city, state, country) AS title, coalesce({_KIND}, {_TYPE}) AS kind FROM f WHERE HAS),
 good AS (SELECT *, coalesce(osm_type || CAST(osm_id AS STRING), concat(CAST(lat AS STRING), ',', CAST(lon AS STRING))) AS id FROM named WHERE title IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180)
SELECT id, title AS name, context, kind, radius_m, lat, lon, admin_city, admin_state, admin_country, neighbourhood FROM (
 SELECT id, title, lat, lon, kind, concat_ws(', ', {", ".join(f"CASE WHEN {_fresh(k)} THEN {p} END" for k, p in enumerate(_PARTS))}) AS context, CASE WHEN kind IN ('city', 'town') THEN 1500 WHEN kind IN ('building', 'amenity', 'house') THEN 400 ELSE 900 END AS radius_m,
  coalesce(a_city, a_town, a_village, a_municipality, a_county) AS admin_city, a_state AS admin_state, a_country AS admin_country, coalesce(a_neighbourhood, a_suburb, a_quarter) AS neighbourhood, row_number() OVER (PARTITION BY id ORDER BY place_ord) AS nth FROM good) q WHERE nth = 1"""
# features of a geocoder: a name (else number and street, city, state or country), a context line that repeats nothing, kind
# and radius; without a name or a place on earth they go, the first of an id stays
operator("normalise_places", "place_features", _PLACES.replace("READ", _READ, 1).replace("spot[FIRST]", "get(spot, 0)").replace("spot[SECOND]", "get(spot, 1)").replace("HAS", "size(spot) >= 2"), _PLACES.replace("READ", _PLAIN_READ, 1).replace("spot[FIRST]", "spot[1]").replace("spot[SECOND]", "spot[2]").replace("HAS", "len(spot) >= 2"))

# the newest eight of a user's searches, one for each name in small letters and place at four decimals
operator("recent_searches", "searches", """
SELECT user_id, name, lat, lon, ms, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) AS place FROM (
 SELECT user_id, event_id, name, round(lat, 4) AS lat, round(lon, 4) AS lon, ms, row_number() OVER (PARTITION BY user_id, lower(name), round(lat, 4), round(lon, 4) ORDER BY ms DESC, event_id DESC) AS nth FROM {searches}) b WHERE nth = 1) c WHERE place <= 8""")  # fmt: skip

