"""Polygons around districts, detailed outlines, far and crowded features, and documents read back by splits."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from queries import world as W
from queries.registry import query, r
from queries.spatial import _MARGIN_DISTRICTS, _geojson_texts
from queries.world import sql, sql_lattice, sql_utm
from regionscore.functions import geometry as G
from regionscore.operators import spatial as SP
from regionscore.operators.nearest import nearest
from regionscore.operators.region_index import build_index
from regionscore.operators.validity import geometry_grammar
from regionscore.sinks import export as EX
from regionscore.sinks.layers import read_box, write_layer
from regionscore.sources.features import read_features
from regionscore.sources.splits import _CONTROLS, _WINDOWS, read_csv
from regionscore.storage import new_path


def sites(spark, sf):
    """A rectangle per part: most are small, every twentieth is larger than a district."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    x, y = W.lattice(k, 6000, 2801, 50000, 1801)
    large = k % 20 == 0
    west, south = F.when(large, x - 500).otherwise(x), F.when(large, y - 400).otherwise(y)
    east, north = F.when(large, x + 900).otherwise(x + size + 4), F.when(large, y + 700).otherwise(y + size + 2)
    return W.table(spark, sf, "part").select(k.alias("site"), F.col("p_type").alias("kind"), G.polygon(W._ring(west, south, east, north)).alias("geom"))


_SX, _SY = sql_lattice("k", 6000, 2801, 50000, 1801)
SITES = f"""site0 AS (SELECT k, size, k % 20 = 0 AS large, {_SX} AS x, {_SY} AS y FROM (SELECT p_partkey AS k, p_size AS size FROM part)),
site AS (SELECT k, (CASE WHEN large THEN x - 500 ELSE x END) / 1000::DOUBLE AS x0, (CASE WHEN large THEN y - 400 ELSE y END) / 1000::DOUBLE AS y0,
  (CASE WHEN large THEN x + 900 ELSE x + size + 4 END) / 1000::DOUBLE AS x1, (CASE WHEN large THEN y + 700 ELSE y + size + 2 END) / 1000::DOUBLE AS y1 FROM site0)"""
MEETS = "x0 <= e AND x1 >= w AND y0 <= t AND y1 >= s AND NOT (holed AND x0 > hw AND x1 < he AND y0 > hs AND y1 < ht)"


@query("sites_meeting_districts", sql(f"SELECT nuts_code, k AS site FROM site JOIN d ON {MEETS}", "d", extra=SITES))
def sites_meeting_districts(spark, sf):
    """Polygon features against regions, those around a whole region included."""
    return SP.intersect_pairs(sites(spark, sf), "site", W.prepared(spark, sf).index, keep=["kind"]).select("nuts_code", "site")


_CORNERS = f"""{SITES},
corner0 AS (SELECT k, i, CASE WHEN i IN (0, 3) THEN x0 ELSE x1 END AS lon, CASE WHEN i < 2 THEN y0 ELSE y1 END AS lat FROM site, range(4) r(i)),
{sql_utm("corner0", "corner", [("lon", "lat", "x", "y")])},
part_side AS (SELECT a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bz FROM corner a JOIN corner b ON a.k = b.k AND b.i = (a.i + 1) % 4)"""


def _apart(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """SQL for the distance of a point and a segment."""
    share = f"greatest(0, least(1, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (({bx} - {ax}) ** 2 + ({by} - {ay}) ** 2)))"
    return f"sqrt(({px} - {ax} - {share} * ({bx} - {ax})) ** 2 + ({py} - {ay} - {share} * ({by} - {ay})) ** 2)"


_NEAR = "least(" + ", ".join([
    _apart("ax", "ay", "px", "py", "qx", "qy"), _apart("bx", "bz", "px", "py", "qx", "qy"), _apart("px", "py", "ax", "ay", "bx", "bz"), _apart("qx", "qy", "ax", "ay", "bx", "bz"),
]) + ") <= 10000"


@query("sites_within_margin", sql(
    f"SELECT k AS site FROM site JOIN d ON {MEETS} WHERE nuts_code IN {_MARGIN_DISTRICTS} "
    f"UNION SELECT k FROM part_side JOIN (SELECT side.* FROM side JOIN d USING (n) WHERE nuts_code IN {_MARGIN_DISTRICTS}) z ON {_NEAR}",
    "side", "d", extra=_CORNERS))
def sites_within_margin(spark, sf):
    """Polygon features in the context margin, those around a whole region included."""
    some = W.prepared(spark, sf).table.where(f"nuts_code IN {_MARGIN_DISTRICTS}")
    return SP.within_distance(sites(spark, sf), some, feature_id="site").select("site")


# No position of the lattice lies between the circle and its 20,000 chords: their squared radii differ by 4e-9 square
# degrees, squared distances of the lattice are whole millionths, and the radius is half a millionth off one.
ZONE_EDGES, ZONE_RADIUS_2 = 20_000, 0.0900005


@query("stations_in_detailed_zones", sql(
    f"SELECT source_id, nuts_code AS zone FROM st JOIN d ON (lon - (w + e) / 2) ** 2 + (lat - (s + t) / 2) ** 2 <= {ZONE_RADIUS_2}", "st", "d"))
def stations_in_detailed_zones(spark, sf):
    """A circle of 20,000 edges around each district's middle; neighbouring circles overlap."""
    n = F.col("n_nationkey").cast("bigint")
    mid_x, mid_y = (6300 + 600 * (n % 5)) / 1000.0, (50200 + 400 * F.floor(n / 5)) / 1000.0
    radius = math.sqrt(ZONE_RADIUS_2)

    def at(i):
        angle = i * (2 * math.pi / ZONE_EDGES)
        return F.struct((mid_x + radius * F.cos(angle)).alias("x"), (mid_y + radius * F.sin(angle)).alias("y"))

    ring = F.transform(F.sequence(F.lit(0), F.lit(ZONE_EDGES - 1)), at)
    circle = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(F.concat(ring, F.slice(ring, 1, 1)))).alias("parts"))
    zones = W.table(spark, sf, "nation").select(F.format_string("DEA%02d", n).alias("zone"), circle.alias("geom"))
    points = W.stations(spark, sf).select("source_id", "lon", "lat")
    found = SP.assign_regions(points, point_id="source_id", region_id="zone", ambiguous="all", index=build_index(zones, "zone", "geom"))
    return found.select("source_id", "zone")


# --- nearest: far origins, and features most of which crowd in one place


def _hubs(k):
    """A place per part in metres: nine in ten within a few hundred metres, the others in a far cluster."""
    crowd = k % 10 < 9
    x = F.when(crowd, 500_000 + k * 7919 % 1009 / 4.0).otherwise(900_000 + k * 7919 % 20011)
    y = F.when(crowd, 5_600_000 + k * 104729 % 1013 / 4.0).otherwise(5_200_000 + k * 104729 % 20021)
    return x.cast("double"), y.cast("double")


_HUB = """hub AS (SELECT k, CASE WHEN k % 10 < 9 THEN 500000 + (k * 7919 % 1009) / 4.0::DOUBLE ELSE 900000 + k * 7919 % 20011 END AS hx,
  CASE WHEN k % 10 < 9 THEN 5600000 + (k * 104729 % 1013) / 4.0::DOUBLE ELSE 5200000 + k * 104729 % 20021 END AS hy FROM (SELECT p_partkey AS k FROM part)),
org AS (SELECT c, CASE WHEN c % 3 = 0 THEN 500000 + (c * 6007 % 1021) / 4.0::DOUBLE ELSE c * 6007 % 3000017 END AS ox,
  CASE WHEN c % 3 = 0 THEN 5600000 + (c * 9001 % 1031) / 4.0::DOUBLE ELSE 3000000 + c * 9001 % 4000037 END AS oy FROM (SELECT c_custkey AS c FROM customer))"""


@query("nearest_hub_of_customer", f"WITH {_HUB} SELECT c AS customer, round(min(sqrt((ox - hx) ** 2 + (oy - hy) ** 2)), 3) AS distance_m FROM org, hub GROUP BY c")
def nearest_hub_of_customer(spark, sf):
    """Origins spread over thousands of kilometres, a third of them in the crowded place itself."""
    x, y = _hubs(F.col("p_partkey"))
    hubs = W.table(spark, sf, "part").select(F.col("p_partkey").alias("hub"), x.alias("x"), y.alias("y"))
    c = F.col("c_custkey")
    near = c % 3 == 0
    origins = W.table(spark, sf, "customer").select(
        c.alias("customer"),
        F.when(near, 500_000 + c * 6007 % 1021 / 4.0).otherwise(c * 6007 % 3000017).cast("double").alias("x"),
        F.when(near, 5_600_000 + c * 9001 % 1031 / 4.0).otherwise(3_000_000 + c * 9001 % 4000037).cast("double").alias("y"),
    )
    found = nearest(origins, SP.point_segments(hubs, "hub", "x", "y"), origin_id="customer", feature_id="hub", x="x", y="y")
    return found.select("customer", r("distance_m", 3))


# --- documents read back by splits


def _messy(k, name):
    """Text with what a CSV field must keep: separators, doubled quotes, line breaks, letters beyond ASCII."""
    odd = F.array(*[F.lit(x) for x in ("; and ,", '"quoted"', "a\nbreak", "Straße – €", "", '5" pipe')])
    return F.concat(name, F.get(odd, (k % 6).cast("int")))


_ODD = "['; and ,', '\"quoted\"', 'a' || chr(10) || 'break', 'Straße – €', '', '5\" pipe']"


def _csv_back(spark, sf, encoding: str, sep: str):
    """Customers written as CSV text and read back; every task writes a file with a header."""
    t = W.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), _messy(F.col("c_custkey"), F.col("c_name")).alias("name"), "c_mktsegment")
    quoted = F.concat(F.lit('"'), F.replace("name", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(sep, F.col("k").cast("string"), quoted, "c_mktsegment")
    body = t.select(line.alias("value"))
    head = spark.range(1).select(F.lit(sep.join(("k", "name", "segment"))).alias("value"))
    if encoding != "UTF-8":
        raw = F.encode(F.translate("value", _WINDOWS, _CONTROLS), "ISO-8859-1").cast("string")
        body = body.select(raw.alias("value"))
    path = new_path(spark, "csv")
    body.write.text(path)
    head.write.mode("append").text(path)
    rows = read_csv(spark, path, ["k", "name", "segment"], sep=sep, encoding=encoding, skip_first=False)
    return rows.where("k <> 'k'").select(F.col("k").cast("bigint").alias("c_custkey"), "name", "segment")


_CSV_SQL = f"SELECT c_custkey, c_name || {_ODD}[c_custkey % 6 + 1] AS name, c_mktsegment AS segment FROM customer"


@query("csv_read_back", _CSV_SQL)
def csv_read_back(spark, sf):
    """Quoted line breaks and separators in UTF-8."""
    return _csv_back(spark, sf, "UTF-8", ",")


@query("register_csv_read_back", _CSV_SQL)
def register_csv_read_back(spark, sf):
    """The same in the register's other encoding, with semicolons."""
    return _csv_back(spark, sf, "windows-1252", ";")


@query("collection_read_back", sql(
    "SELECT osm_id AS source_id, road_class AS name, 3 AS positions, ax / 1000::DOUBLE AS x, ay / 1000::DOUBLE AS y FROM road", "road"))
def collection_read_back(spark, sf):
    """Roads written as GeoJSON documents and read by as many tasks as these have splits."""
    from regionscore.functions.geojson import geometry_to_json

    properties = F.to_json(F.struct(F.col("road_class").alias("name"), F.lit('a } "brace" ] in text').alias("note")))
    feature = F.concat(F.lit('{"type":"Feature","id":"'), F.col("osm_id"), F.lit('","properties":'), properties, F.lit(',"geometry":'), geometry_to_json(F.col("geom")), F.lit("}"))
    path = new_path(spark, "collections")
    # about 200 roads a document
    dealt = W.roads(spark, sf).select(F.floor(F.col("k") / 200).alias("document"), feature.alias("feature"))
    listed = dealt.groupBy("document").agg(F.array_join(F.collect_list("feature"), ",").alias("features"))
    head = json.dumps({"type": "FeatureCollection", "features": []})[:-2]
    listed.select(F.concat(F.lit(head), F.col("features"), F.lit("]}")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    accepted, _ = read_features(spark, path, id_keys=("id",), properties=("name",), kinds=("LineString",))
    first = F.get(G.positions(F.col("geom")), F.lit(0))
    return accepted.select("source_id", "name", F.size(G.positions(F.col("geom"))).alias("positions"), first["x"].alias("x"), first["y"].alias("y"))


# --- layers laid out for box reads


def _box_of(layer, path, spark, key):
    write_layer(layer, path, rows_per_file=500)
    return read_box(spark, path, 6.76, 50.4, 7.2, 51.24).select(key)


@query("sites_in_box", sql("SELECT k AS site FROM site WHERE x0 <= 7.2 AND x1 >= 6.76 AND y0 <= 51.24 AND y1 >= 50.4", extra=SITES))
def sites_in_box(spark, sf):
    """Polygons of a written layer whose box meets a box."""
    return _box_of(sites(spark, sf), new_path(spark, "sites"), spark, "site")


@query("roads_in_box", sql(
    "SELECT osm_id FROM (SELECT osm_id, least(ax, bx, cx) AS x0, greatest(ax, bx, cx) AS x1, least(ay, bz, cy) AS y0, greatest(ay, bz, cy) AS y1 FROM road) WHERE x0 <= 7200 AND x1 >= 6760 AND y0 <= 51240 AND y1 >= 50400", "road"))
def roads_in_box(spark, sf):
    """The same on lines."""
    return _box_of(W.roads(spark, sf).drop("k"), new_path(spark, "roads"), spark, "osm_id")


@query("written_order", sql("SELECT 'roads: features are in order' AS check, 0::BIGINT AS violations UNION ALL SELECT 'unordered: features are in order', count(*) FROM (SELECT k, lag(k) OVER (ORDER BY k) AS p FROM road) WHERE k::VARCHAR < p::VARCHAR", "road"))
def written_order(spark, sf):
    """Lines of a layer exported in order, and of one written by number although its keys are text."""
    ordered, other = new_path(spark, "ordered"), new_path(spark, "unordered")
    EX.export_features(W.roads(spark, sf).withColumnRenamed("osm_id", "source_id"), "source_id", ordered)
    text = W.roads(spark, sf).select("k", F.concat(F.lit('{"properties":{"source_id":"'), F.col("k").cast("string"), F.lit('"}}')).alias("value"))
    text.orderBy("k").select("value").write.text(other)
    return EX.check_order(spark, ordered, "roads", "source_id").union(EX.check_order(spark, other, "unordered", "source_id"))


@query("nested_geometry_grammar", sql(
    "SELECT k, NOT ((k % 6 = 2 AND k % 13 = 0) OR (k % 6 IN (4, 5) AND k % 11 = 0)) AND NOT (k % 17 = 0 AND k % 5 > 0) AS valid FROM (SELECT event_id AS k FROM events)"))
def nested_geometry_grammar(spark, sf):
    """All seven kinds, in up to four nested collections; some of the innermost collections are empty."""
    t = _geojson_texts(spark, sf)
    plain = F.concat(F.lit('{"type":"'), F.col("kind"), F.lit('","coordinates":'), F.col("coordinates"), F.lit("}"))
    empty = F.lit('{"type":"GeometryCollection","geometries":[]}')
    k = F.col("k")
    text = F.when((k % 17 == 0) & (k % 5 > 0), empty).otherwise(plain)
    for depth in range(1, 5):
        around = F.concat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[7,51]},'), text, F.lit("]}"))
        text = F.when(k % 5 >= depth, around).otherwise(text)
    return geometry_grammar(t.select("k", text.alias("document")), "k", "document")
