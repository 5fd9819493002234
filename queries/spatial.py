"""Geometry operators and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import world as W
from queries.registry import big, query, r
from queries.world import INSIDE, sql, sql_lattice, sql_utm
from regionscore.functions import geometry as G
from regionscore.functions.geojson import geojson_is_valid, geometry_from_json, geometry_to_json
from regionscore.functions.projection import project_utm, with_utm
from regionscore.operators import spatial as SP
from regionscore.operators.nearest import nearest
from regionscore.operators.validity import structure_report, topology_report
from regionscore.storage import materialize

FLAT_LATTICE = sql_lattice("k")


@query("utm_projection", sql("SELECT source_id, round(x, 3) AS x, round(y, 3) AS y FROM st_m", "st_m"))
def utm_projection(spark, sf):
    return with_utm(W.stations(spark, sf).select("source_id", "lon", "lat"), "lon", "lat").select(
        "source_id", r("x", 3), r("y", 3)
    )


def parcels(spark, sf):
    """One rectangle per part, some with a hole, some as two parts."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    x, y = W.lattice(k, 6000, 2801, 50000, 1801)
    ring = lambda x0, y0, x1, y1: W._ring(x0, y0, x1, y1)
    shell = ring(x, y, x + size + 4, y + size + 2)
    plain = G.polygon(shell)
    holed = G.polygon(shell, ring(x + 1, y + 1, x + 2, y + 2))
    far = G.polygon(ring(x + 100, y, x + 101, y + 1))
    double = F.struct(F.lit("MultiPolygon").alias("type"), F.concat(plain["parts"], far["parts"]).alias("parts"))
    geom = F.when(k % 3 == 0, plain).when(k % 3 == 1, holed).otherwise(double)
    return W.table(spark, sf, "part").select(k.alias("parcel"), geom.alias("geom"))


_PX, _PY = sql_lattice("k", 6000, 2801, 50000, 1801)
PARCEL_SQL = f"""
p0 AS (SELECT k, size, {_PX} AS x0, {_PY} AS y0 FROM (SELECT p_partkey AS k, p_size AS size FROM part)),
box AS (SELECT k, 0 AS b, 1 AS sg, x0, y0, x0 + size + 4 AS x1, y0 + size + 2 AS y1 FROM p0
  UNION ALL SELECT k, 1, -1, x0 + 1, y0 + 1, x0 + 2, y0 + 2 FROM p0 WHERE k % 3 = 1
  UNION ALL SELECT k, 2, 1, x0 + 100, y0, x0 + 101, y0 + 1 FROM p0 WHERE k % 3 = 2),
c0 AS (SELECT k, b, sg, i, (CASE WHEN i IN (0, 3) THEN x0 ELSE x1 END) / 1000::DOUBLE AS lon, (CASE WHEN i < 2 THEN y0 ELSE y1 END) / 1000::DOUBLE AS lat FROM box, range(4) t(i)),
{sql_utm("c0", "cp", [("lon", "lat", "x", "y")])},
o AS (SELECT k, min(x) AS ox, min(y) AS oy FROM cp GROUP BY k),
cs AS (SELECT a.k, a.sg, a.x - ox AS ax, a.y - oy AS ay, b.x - ox AS bx, b.y - oy AS bz, ox, oy FROM cp a JOIN cp b ON a.k = b.k AND a.b = b.b AND b.i = (a.i + 1) % 4 JOIN o ON o.k = a.k),
m AS (SELECT k, sum(sg * (ax * bz - bx * ay)) AS c, sum(sg * (ax + bx) * (ax * bz - bx * ay)) AS sx, sum(sg * (ay + bz) * (ax * bz - bx * ay)) AS sy, any_value(ox) AS ox, any_value(oy) AS oy FROM cs GROUP BY k)"""


@query("parcel_areas_and_centroids", sql(
    "SELECT k AS parcel, round(c / 2, 1) AS area_m2, round(ox + sx / (3 * c), 2) AS centroid_x, round(oy + sy / (3 * c), 2) AS centroid_y FROM m",
    extra=PARCEL_SQL))
def parcel_areas(spark, sf):
    p = parcels(spark, sf).withColumn("m", project_utm(F.col("geom")))
    c = G.centroid(F.col("m"))
    return p.select("parcel", r(G.area_m2(F.col("m")), 1).alias("area_m2"), c.alias("c")).select(
        "parcel", "area_m2", r(F.col("c.x"), 2).alias("centroid_x"), r(F.col("c.y"), 2).alias("centroid_y")
    )


@query("parcel_boxes", sql(
    "SELECT k AS parcel, min(x0) / 1000::DOUBLE AS xmin, min(y0) / 1000::DOUBLE AS ymin, max(x1) / 1000::DOUBLE AS xmax, max(y1) / 1000::DOUBLE AS ymax FROM box GROUP BY k",
    extra=PARCEL_SQL))
def parcel_boxes(spark, sf):
    return parcels(spark, sf).select("parcel", G.bbox(F.col("geom")).alias("b")).select("parcel", "b.*")


@query("line_lengths", sql(
    "SELECT id AS osm_id, round(sum(sqrt((pbx - pax) ** 2 + (pby - pay) ** 2)), 3) AS length_m, "
    "round(sum(sqrt(((bx - ax) * cos(radians((ay + bz) / 2))) ** 2 + (bz - ay) ** 2)), 9) AS scaled_length FROM road_seg GROUP BY id",
    "road_seg"))
def line_lengths(spark, sf):
    lines = W.roads(spark, sf)
    return lines.select(
        "osm_id",
        r(G.length_m(project_utm(F.col("geom"))), 3).alias("length_m"),
        r(G.scaled_degree_length(F.col("geom")), 9).alias("scaled_length"),
    )


@query("station_owner_districts", sql("SELECT source_id, nuts_code FROM owner", "owner"))
def station_owner_districts(spark, sf):
    points = W.stations(spark, sf).select("source_id", "lon", "lat")
    owned = SP.assign_regions(points, point_id="source_id", index=W.prepared(spark, sf).index)
    return owned.select("source_id", "nuts_code")


@query("stations_in_one_district_only", sql(
    f"SELECT source_id, min(nuts_code) AS nuts_code FROM st JOIN d ON {INSIDE} GROUP BY source_id HAVING count(*) = 1", "st", "d"))
def stations_in_one_district_only(spark, sf):
    points = W.stations(spark, sf).select("source_id", "lon", "lat")
    owned = SP.assign_regions(points, point_id="source_id", ambiguous="reject", index=W.prepared(spark, sf).index)
    return owned.select("source_id", "nuts_code")


@query("stations_covered_by_each_district", sql(
    f"SELECT nuts_code, count(st.source_id) AS stations, coalesce(sum(power_kw), 0) AS power_kw FROM d LEFT JOIN st ON {INSIDE} GROUP BY nuts_code", "st", "d"))
def stations_covered_by_each_district(spark, sf):
    d = W.prepared(spark, sf)
    rolled = SP.count_in_regions(
        W.stations(spark, sf).select("source_id", "lon", "lat", "power_kw"),
        d.table,
        {"stations": F.count("*"), "power_kw": F.sum("power_kw")},
        point_id="source_id",
        index=d.index,
    )
    return rolled.select(
        "nuts_code", F.coalesce("stations", F.lit(0)).alias("stations"), F.coalesce("power_kw", F.lit(0.0)).alias("power_kw")
    )


@query("stations_in_any_district", sql(f"SELECT source_id FROM st WHERE EXISTS (SELECT 1 FROM d WHERE {INSIDE})", "st", "d"))
def stations_in_any_district(spark, sf):
    points = W.stations(spark, sf).select("source_id", "lon", "lat")
    return SP.in_any_region(points, index=W.prepared(spark, sf).index).select("source_id")


@query("road_lengths_by_district", sql(
    "SELECT nuts_code, id AS osm_id, round(km, 6) AS length_km FROM rclip JOIN d USING (n)", "rclip", "d"))
def road_lengths_by_district(spark, sf):
    d = W.prepared(spark, sf)
    parts = SP.clip_lengths(
        W.roads(spark, sf), d.table, line_id="osm_id", index=d.index, metric_index=d.metric_index
    )
    return parts.select("nuts_code", "osm_id", r("length_km", 6))


@query("substations_meeting_districts", sql(
    f"SELECT nuts_code, source_id FROM sub JOIN d ON {INSIDE}", "sub", "d"))
def substations_meeting_districts(spark, sf):
    substations = W.grid(spark, sf).where(F.col("asset_type").isin("substation", "transformer"))
    return SP.intersect_pairs(substations, "source_id", W.prepared(spark, sf).index)


@query("nearest_station_of_district", sql("SELECT nuts_code, round(distance_m, 3) AS distance_m FROM near_st", "near_st"))
def nearest_station_of_district(spark, sf):
    points = with_utm(W.stations(spark, sf).select("source_id", "lon", "lat"), "lon", "lat")
    found = nearest(
        W.prepared(spark, sf).measures,
        SP.point_segments(points, "source_id", "x", "y"),
        origin_id="nuts_code",
        feature_id="source_id",
    )
    return found.select("nuts_code", r("distance_m", 3))


@query("nearest_road_of_district", sql("SELECT nuts_code, round(distance_m, 3) AS distance_m FROM near_road", "near_road"))
def nearest_road_of_district(spark, sf):
    found = SP.nearest_feature(
        W.prepared(spark, sf).measures, W.roads(spark, sf), origin_id="nuts_code", feature_id="osm_id"
    )
    return found.select("nuts_code", r("distance_m", 3))


@query("nearest_substation_of_station", sql(
    "SELECT a.source_id, min(struct_pack(d := round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 3), i := b.source_id)).i AS substation, "
    "min(round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 3)) AS distance_m FROM st_m a, sub b GROUP BY a.source_id", "st_m", "sub"))
def nearest_substation_of_station(spark, sf):
    """Many origins against many features."""
    origins = with_utm(W.stations(spark, sf).select("source_id", "lon", "lat"), "lon", "lat")
    substations = W.grid(spark, sf).where(F.col("asset_type").isin("substation", "transformer")).select(
        F.col("source_id").alias("substation"), "geom"
    )
    segments = SP.metre_segments(substations, "substation")
    found = nearest(origins, segments, origin_id="source_id", feature_id="substation", x="x", y="y")
    return found.select("source_id", "substation", r("distance_m", 3))


_MARGIN_DISTRICTS = "('DEA06', 'DEA07', 'DEA12')"


@query("stations_within_margin", sql(
    f"""SELECT DISTINCT source_id FROM st_m JOIN (SELECT side.*, nuts_code, w, s, e, t, hw, hs, he, ht, holed FROM side JOIN d USING (n) WHERE nuts_code IN {_MARGIN_DISTRICTS}) z
    ON ({INSIDE}) OR sqrt((x - px - greatest(0, least(1, ((x - px) * (qx - px) + (y - py) * (qy - py)) / ((qx - px) ** 2 + (qy - py) ** 2))) * (qx - px)) ** 2
      + (y - py - greatest(0, least(1, ((x - px) * (qx - px) + (y - py) * (qy - py)) / ((qx - px) ** 2 + (qy - py) ** 2))) * (qy - py)) ** 2) <= 10000""",
    "st_m", "side", "d"))
def stations_within_margin(spark, sf):
    """Context margin: in a district or within ten kilometres of one."""
    some = W.prepared(spark, sf).table.where(f"nuts_code IN {_MARGIN_DISTRICTS}")
    points = W.stations(spark, sf).select("source_id", G.point(F.col("lon"), F.col("lat")).alias("geom"))
    return SP.within_distance(points, some, feature_id="source_id").select("source_id")


@query("stations_in_box", sql(
    "SELECT source_id, lon, lat FROM st WHERE lon BETWEEN 6.76 AND 7.2 AND lat BETWEEN 50.4 AND 51.24 AND power_kw = 150", "st"))
def stations_in_box(spark, sf):
    return SP.read_box(
        W.stations(spark, sf).select("source_id", "lon", "lat", "power_kw"), 6.76, 50.4, 7.2, 51.24, where=F.col("power_kw") == 150
    ).select("source_id", "lon", "lat")


def _geojson_texts(spark, sf):
    """A geometry text of every kind per event, some broken by rule."""
    k = F.col("event_id")
    lon, lat = W.lattice(k)
    x, y = (lon / 1000.0).cast("string"), (lat / 1000.0).cast("string")
    x2 = ((lon + 10) / 1000.0).cast("string")
    p, q = F.concat(F.lit("["), x, F.lit(","), y, F.lit(",7.5]")), F.concat(F.lit("["), x2, F.lit(","), y, F.lit("]"))
    s = F.concat(F.lit("["), x2, F.lit(","), ((lat + 10) / 1000.0).cast("string"), F.lit("]"))
    flat = F.concat(F.lit("["), x, F.lit(","), y, F.lit("]"))
    line = F.concat(F.lit("["), flat, F.lit(","), q, F.lit("]"))
    ring = F.concat(F.lit("["), flat, F.lit(","), q, F.lit(","), s, F.lit(","), F.when(k % 11 == 0, q).otherwise(flat), F.lit("]"))
    wrap = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    kinds = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
    coords = (p, line, F.when(k % 13 == 0, wrap(flat)).otherwise(line), wrap(line), wrap(ring), wrap(wrap(ring)))
    kind, text = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for i, (name, c) in enumerate(zip(kinds, coords)):
        kind, text = kind.when(k % 6 == i, name), text.when(k % 6 == i, c)
    return W.table(spark, sf, "events").select(k.alias("k"), kind.alias("kind"), text.alias("coordinates"))


@query("geojson_grammar", sql(
    "SELECT k, NOT ((k % 6 = 2 AND k % 13 = 0) OR (k % 6 IN (4, 5) AND k % 11 = 0)) AS valid FROM (SELECT event_id AS k FROM events)"))
def geojson_grammar(spark, sf):
    t = _geojson_texts(spark, sf)
    return t.select("k", geojson_is_valid(F.col("kind"), F.col("coordinates")).alias("valid"))


@query("geojson_roundtrip", sql(
    f"""SELECT k, ['Point', 'MultiPoint', 'LineString', 'MultiLineString', 'Polygon', 'MultiPolygon'][k % 6 + 1] AS kind,
    CASE k % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN CASE WHEN k % 13 = 0 THEN 1 ELSE 2 END WHEN 3 THEN 2 ELSE 4 END AS positions,
    {FLAT_LATTICE[0]} / 1000::DOUBLE AS x, {FLAT_LATTICE[1]} / 1000::DOUBLE AS y, true AS same FROM (SELECT event_id AS k FROM events)"""))
def geojson_roundtrip(spark, sf):
    t = _geojson_texts(spark, sf).withColumn("geom", geometry_from_json(F.col("kind"), F.col("coordinates")))
    again = F.from_json(geometry_to_json(F.col("geom")), "type string, coordinates string")
    t = t.withColumn("back", geometry_from_json(again["type"], again["coordinates"]))
    first = F.get(G.positions(F.col("geom")), F.lit(0))
    return t.select(
        "k",
        F.col("geom.type").alias("kind"),
        F.size(G.positions(F.col("geom"))).alias("positions"),
        first["x"].alias("x"),
        first["y"].alias("y"),
        (F.col("geom") == F.col("back")).alias("same"),
    )


def _outlines(spark, sf):
    """One outline per part following its key: sound ones and every kind of unsound one."""
    k = F.col("p_partkey")
    gx, gy = W.lattice(k, 0, 3000, 0, 2000)
    at = lambda x, y: ((gx * 4 + x) / 4.0, (gy * 4 + y) / 4.0)
    ring = lambda *ps: [at(x, y) for x, y in (*ps, ps[0])]
    multi = lambda *polys: F.struct(
        F.lit("MultiPolygon").alias("type"), F.concat(*[p["parts"] for p in polys]).alias("parts")
    )
    # the key moves a vertex of every sound outline
    tip = (F.pmod(k, F.lit(7)) + 10).cast("double")
    kite = ring((0, 6), (6, 0), (16, 6), (6, tip))
    step = ring((0, 0), (18, 0), (18, 5), (9, 5), (9, 12), (0, 12))
    left, right = ring((1, 1), (4, 1), (2, 4)), ring((11, 1), (16, 1), (16, 3))
    cases = (
        G.polygon(kite),
        G.polygon(step, left, right),
        multi(G.polygon(kite), G.polygon(ring((20, 0), (26, 1), (22, 7))), G.polygon(ring((20, 9), (26, 9), (23, 14)))),
        G.polygon(ring((3, 3), (5, 3), (3, 3))),
        G.polygon(ring((0, 0), (12, 10), (12, 0), (6, 12), (0, 10))),
        G.polygon(ring((2, 1), (5, 4), (11, 10))),
        G.polygon(step, left, ring((22, 2), (25, 2), (24, 5))),
        G.polygon(step, left, ring((7, 3), (11, 4), (11, 8), (7, 8))),
        multi(G.polygon(kite), G.polygon(ring((20, 0), (26, 1), (22, 7))), G.polygon(ring((23, 3), (29, 3), (25, 9)))),
        multi(G.polygon(step), G.polygon(ring((18, 0), (24, 2), (18, 5)))),
        multi(G.polygon(step), G.polygon(left), G.polygon(ring((22, 2), (25, 2), (24, 5)))),
        G.polygon(ring((0, 0), (30, 0), (30, 30), (0, 30)), ring((2, 2), (26, 4), (6, 26)), ring((8, 8), (12, 8), (9, 11))),
        G.polygon([at(1, 0), at(9, 2), at(4, 8)]),
        G.polygon([at(1, 0), at(9, 2), at(4, 8), at(0, 5)]),
        G.polygon([at(1, 0), (F.lit(float("inf")), F.lit(2.0)), at(4, 8), at(1, 0)]),
        G.point(*at(5, 5)),
    )
    geom = F.when(F.lit(False), G.point(F.lit(0.0), F.lit(0.0)))
    for i, c in enumerate(cases):
        geom = geom.when(k % len(cases) == i, c)
    return materialize(W.table(spark, sf, "part").select(k.alias("region"), geom.alias("geom")), "outlines")


@query("outline_structure_report", sql(
    "SELECT k AS region, ['exterior ring with fewer than four positions', 'unclosed exterior ring', 'non-finite exterior ring position', 'unsupported geometry'][k % 16 - 11] AS reason "
    "FROM (SELECT p_partkey AS k FROM part) WHERE k % 16 >= 12"))
def outline_structure_report(spark, sf):
    return structure_report(_outlines(spark, sf), region_id="region")


@query("outline_topology_report", sql(
    "SELECT k AS region, CASE k % 16 WHEN 3 THEN 'too few points' WHEN 6 THEN 'hole outside shell' WHEN 10 THEN 'nested shells' WHEN 11 THEN 'nested holes' ELSE 'self-intersection' END AS reason "
    "FROM (SELECT p_partkey AS k FROM part) WHERE k % 16 BETWEEN 3 AND 11"))
def outline_topology_report(spark, sf):
    outlines = _outlines(spark, sf)
    broken = structure_report(outlines, region_id="region")
    return topology_report(outlines.join(broken, "region", "left_anti"), region_id="region")


@query("distance_to_district_outline", sql(
    "SELECT k, round(CASE WHEN inner_point THEN least(lon - hw, he - lon, lat - hs, ht - lat) ELSE sqrt(greatest(0, w - lon, lon - e) ** 2 + greatest(0, s - lat, lat - t) ** 2) END, 9) AS degrees, (lon BETWEEN w AND e AND lat BETWEEN s AND t AND NOT inner_point) AS covered "
    "FROM (SELECT *, n = 12 AND lon > hw AND lon < he AND lat > hs AND lat < ht AS inner_point FROM (SELECT k, lon, lat, (k * 7 % 25)::INTEGER AS j FROM st) q JOIN d ON d.n = q.j)", "st", "d"))
def distance_to_district_outline(spark, sf):
    """Planar distance of each station to one district picked by its key (0 inside)."""
    s = W.stations(spark, sf).select("k", "lon", "lat", F.format_string("DEA%02d", F.col("k") * 7 % 25).alias("nuts_code"))
    joined = s.join(W.prepared(spark, sf).table.select("nuts_code", "geom"), "nuts_code")
    point = G.point(F.col("lon"), F.col("lat"))
    return joined.select(
        big("k"),
        r(G.distance(point, F.col("geom")), 9).alias("degrees"),
        G.covers(F.col("geom"), F.col("lon"), F.col("lat")).alias("covered"),
    )
