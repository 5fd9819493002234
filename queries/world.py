"""The driver's tables read as a region world, in Spark and, independently, in SQL.

Districts are the nations laid out as rectangles (one has a hole); keys give every other table
a position on a fine lattice that includes the district borders, so border rules are exercised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionscore.functions import geometry as G
from regionscore.plans import measures as M
from regionscore.plans import refresh as R
from regionscore.schemas import SOURCE_SNAPSHOTS

HOLE_DISTRICT = 12

# Constants of the SQL twins' own projection, from the inverse flattening of GRS80 and its major axis.
INVERSE_FLATTENING, MAJOR_AXIS, SCALE = 298.257222101, 6_378_137.0, 0.9996
THIRD = 1 / (2 * INVERSE_FLATTENING - 1)
ECCENTRICITY = (2 / INVERSE_FLATTENING - 1 / INVERSE_FLATTENING**2) ** 0.5
RECTIFYING = MAJOR_AXIS * (64 + 16 * THIRD**2 + THIRD**4) / (64 * (1 + THIRD))
ALPHA = (
    THIRD * (1 / 2 + THIRD * (-2 / 3 + THIRD * (5 / 16 + THIRD * 41 / 180))),
    THIRD**2 * (13 / 48 + THIRD * (-3 / 5 + THIRD * 557 / 1440)),
    THIRD**3 * (61 / 240 - THIRD * 103 / 140),
    THIRD**4 * 49561 / 161280,
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows as they were read; the reader decides the splits."""
    return df


def _thousandths(value: Column) -> Column:
    return value / F.lit(1000.0)


def lattice(key: Column, west: int = 5950, width: int = 3101, south: int = 49950, height: int = 2101):
    """A position in thousandths of a degree for any integer key."""
    return F.lit(west) + key * 7919 % width, F.lit(south) + key * 104729 % height


def _ring(west: Column, south: Column, east: Column, north: Column):
    w, s, e, n = (_thousandths(c) for c in (west, south, east, north))
    return [(w, s), (e, s), (e, n), (w, n), (w, s)]


def districts(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    n = F.col("n_nationkey").cast("bigint")
    west, south = 6000 + 600 * (n % 5), 50000 + 400 * F.floor(n / 5)
    plain = G.polygon(_ring(west, south, west + 600, south + 400))
    holed = G.polygon(
        _ring(west, south, west + 600, south + 400), _ring(west + 200, south + 100, west + 400, south + 300)
    )
    return nation.select(
        F.format_string("DEA%02d", n).alias("nuts_code"),
        F.format_string("05%03d", n).alias("ags"),
        F.col("n_name").alias("district_name"),
        F.lit("Nordrhein-Westfalen").alias("region_name"),
        F.when(n == HOLE_DISTRICT, holed).otherwise(plain).alias("geom"),
    )


def stations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    lon, lat = lattice(k)
    none = F.lit(None).cast("string")
    return spread(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")).select(
        F.concat(F.lit("s"), k.cast("string")).alias("source_id"),
        F.col("o_orderpriority").alias("operator"),
        F.col("o_orderstatus").alias("status"),
        F.lit("register").alias("charger_type"),
        F.when(k % 11 != 0, 1 + k % 4).cast("int").alias("charging_points"),
        ((k % 13) * 25.0).alias("power_kw"),
        F.when(k % 7 != 0, (k % 13) * 12.5 + 1.0).alias("max_point_power_kw"),
        none.alias("street"),
        none.alias("postcode"),
        none.alias("city"),
        none.alias("district_text"),
        F.lit("Nordrhein-Westfalen").alias("bundesland"),
        _thousandths(lon).alias("lon"),
        _thousandths(lat).alias("lat"),
        k.alias("k"),
    )


ROAD_CLASSES = ("A", "B", "L", "K", " b ", "motorway", "", None)


def roads(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    ax, ay = lattice(k, 6000, 2801, 50000, 1801)
    bx, by = ax + (k % 7) * 20 + 10, ay + (k % 11) * 15 - 60
    cx, cy = bx + (k % 5) * 30 - 60, by + (k % 3) * 40
    classes = F.array(*[F.lit(c) for c in ROAD_CLASSES])
    return spread(table(spark, sf, "customer").select("c_custkey", "c_name")).select(
        F.concat(F.lit("r"), k.cast("string")).alias("osm_id"),
        F.get(classes, (k % 8).cast("int")).alias("road_class"),
        F.col("c_name").alias("name"),
        F.concat(F.lit(" A"), (k % 37).cast("string")).alias("road_number"),
        F.when(k % 9 != 0, (k % 50) * 200.0).alias("traffic_total"),
        F.lit(None).cast("double").alias("traffic_light"),
        F.lit(None).cast("double").alias("traffic_heavy"),
        F.lit(None).cast("string").alias("counting_station_type"),
        F.lit("counted").alias("source"),
        G.linestring(*[(_thousandths(x), _thousandths(y)) for x, y in ((ax, ay), (bx, by), (cx, cy))]).alias("geom"),
        k.alias("k"),
    )


ASSETS = ("line", "cable", "minor_line", "substation", "transformer")
VOLTAGE_TAGS = ("110000", "110 kV", "380kV", "20000;110000", "-110000", "unknown", "", None, "0;20kv")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    ax, ay = lattice(k, 6000, 2801, 50000, 1801)
    bx, by = ax + (k % 13) * 15 + 5, ay + (k % 17) * 10 - 40
    line = G.linestring((_thousandths(ax), _thousandths(ay)), (_thousandths(bx), _thousandths(by)))
    place = G.point(_thousandths(ax), _thousandths(ay))
    return spread(table(spark, sf, "part").select("p_partkey", "p_name")).select(
        F.concat(F.lit("g"), k.cast("string")).alias("source_id"),
        F.get(F.array(*[F.lit(a) for a in ASSETS]), (k % 5).cast("int")).alias("asset_type"),
        F.get(F.array(*[F.lit(v) for v in VOLTAGE_TAGS]), (k % 9).cast("int")).alias("voltage"),
        F.col("p_name").alias("name"),
        F.when(k % 5 < 3, line).otherwise(place).alias("geom"),
        k.alias("k"),
    )


TECHNOLOGIES = {
    "view": "Windenergie",
    "click": "Photovoltaik Freifläche",
    "purchase": "Photovoltaik Bauliche",
    "signup": "Biomasse",
    "error": "Klärgas",
}


def renewables(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    lon, lat = lattice(k)
    technology = F.when(F.lit(False), "")
    for kind, name in TECHNOLOGIES.items():
        technology = technology.when(F.col("event_type") == kind, name)
    return spread(table(spark, sf, "events").select("event_id", "event_type", "value")).select(
        F.concat(F.lit("e"), k.cast("string")).alias("source_id"),
        F.col("event_type").alias("name"),
        F.lit(None).cast("string").alias("operator"),
        F.lit("generator").alias("asset_type"),
        technology.alias("technology"),
        F.when(k % 17 != 0, F.col("value")).alias("capacity_mw"),
        F.when(k % 10 == 0, "").when(k % 5 == 0, "Stillgelegt").otherwise("In Betrieb").alias("status"),
        _thousandths(lon).alias("lon"),
        _thousandths(lat).alias("lat"),
        k.alias("k"),
    )


def population(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_nationkey").cast("bigint")
    people = table(spark, sf, "customer").groupBy(n.alias("n")).agg((F.count("*") * 1000 + 17).cast("int").alias("population"))
    n = F.col("n")
    return people.select(
        F.format_string("05%03d", n).alias("district_code"),
        F.when(n % 3 != 0, F.format_string("DEA%02d", n)).alias("nuts_code"),
        F.when(n % 3 != 1, F.format_string("05%03d", n)).alias("ags"),
        "population",
        F.lit(2024).alias("reference_year"),
        F.lit("customers").alias("source"),
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly figures per supplier (a municipality) and nation (its district)."""
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    sold = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_quantity", "l_partkey", F.year("l_shipdate").alias("year")
    )
    per = sold.groupBy("l_suppkey", "year").agg(
        F.sum("l_quantity").alias("quantity"), F.sum("l_partkey").alias("parts"), F.count("*").alias("rows")
    )
    m = F.col("l_suppkey")
    return per.join(supplier, per["l_suppkey"] == supplier["s_suppkey"]).select(
        "year",
        F.concat(F.lit("M"), m.cast("string")).alias("municipality_name"),
        F.format_string("DEA%02d", F.col("s_nationkey").cast("bigint")).alias("nuts_code"),
        F.lpad(m.cast("string"), 8, "0").alias("ags"),
        m.alias("m"),
        F.col("s_nationkey").cast("bigint").alias("n"),
        "quantity",
        "parts",
        "rows",
    )


def consumption(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("m")
    return (
        panel(spark, sf)
        .where((m * 7 + F.col("year")) % 29 != 0)
        .select(
            "year",
            "municipality_name",
            F.col("nuts_code").alias("district_name"),
            "nuts_code",
            "ags",
            F.when((m + F.col("year")) % 31 != 0, F.when(F.col("n") == 5, 0.0).otherwise(F.col("quantity"))).alias(
                "consumption_gwh"
            ),
            F.lit(None).cast("double").alias("industry_gwh"),
            F.lit(None).cast("double").alias("commerce_services_gwh"),
            F.lit(None).cast("double").alias("households_gwh"),
            F.lit("shipments").alias("source"),
        )
    )


def balance(spark: SparkSession, sf: str) -> DataFrame:
    m, rows = F.col("m"), F.col("rows").cast("double")
    return panel(spark, sf).select(
        "year",
        "municipality_name",
        F.col("nuts_code").alias("district_name"),
        "nuts_code",
        "ags",
        F.when((m * 3 + F.col("year")) % 37 != 0, F.col("parts").cast("double")).alias("published_generation_mwh"),
        (m % 3).cast("int").alias("generation_components_unknown"),
        F.when(F.col("n") % 7 == 3, 0.0).otherwise(rows).alias("wind_capacity_mw"),
        F.when(m % 19 != 0, rows * 2.0).alias("renewable_capacity_mw"),
        F.when((m * 5 + F.col("year")) % 41 != 0, rows / 4.0).alias("renewable_net_addition_mw"),
        F.lit("shipments").alias("source"),
    )


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Signups as proposals: request id from the user, sizes from the payload, some invalid."""
    k = F.col("event_id")
    lon, lat = lattice(k)
    p = F.get_json_object("props", "$.k").cast("int")
    return (
        table(spark, sf, "events")
        .where(F.col("event_type") == "signup")
        .select(
            k.cast("string").alias("id"),
            F.when(k % 23 == 0, " ").otherwise(F.concat(F.lit(" Proposal "), k.cast("string"))).alias("name"),
            p.alias("charging_points"),
            (p * 10.0).alias("power_kw"),
            F.when(k % 29 != 0, F.when(k % 31 == 0, p * 11.0).otherwise(p * 5.0)).alias("max_point_power_kw"),
            F.format_string("%08x-0000-4000-8000-%012x", F.col("user_id"), F.col("user_id")).alias("request_id"),
            F.concat(F.lit("client-"), (F.col("user_id") % 50).cast("string")).alias("client_id"),
            F.col("ts").alias("created_at"),
            _thousandths(lon).alias("lon"),
            _thousandths(lat).alias("lat"),
        )
    )


def inputs(spark: SparkSession, sf: str) -> R.Inputs:
    return R.Inputs(
        districts=districts(spark, sf),
        stations=stations(spark, sf).drop("k"),
        population=population(spark, sf),
        roads=roads(spark, sf).drop("k"),
        grid=grid(spark, sf).drop("k"),
        renewables=renewables(spark, sf).drop("k"),
        consumption=consumption(spark, sf),
        renewable_balance=balance(spark, sf),
        snapshots=spark.createDataFrame([], SOURCE_SNAPSHOTS),
        motorways=motorways(spark, sf),
    )


def motorways(spark: SparkSession, sf: str) -> DataFrame:
    r = roads(spark, sf)
    return r.select(
        F.col("osm_id").alias("source_id"),
        F.when(F.col("k") % 4 == 0, "trunk").otherwise("motorway").alias("highway"),
        F.when(F.col("k") % 6 != 0, F.col("road_number")).alias("ref"),
        "name",
        "geom",
    )


_DISTRICTS: dict[tuple[str, str], M.Districts] = {}
_ANALYTICS: dict[tuple[str, str], R.Analytics] = {}


def prepared(spark: SparkSession, sf: str) -> M.Districts:
    """Districts with their stored outlines and grids, prepared once per session and data set."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _DISTRICTS:
        _DISTRICTS[key] = M.prepare_districts(districts(spark, sf))
    return _DISTRICTS[key]


def analytics(spark: SparkSession, sf: str) -> R.Analytics:
    """The whole analysis of the world, its district tables stored once per session and data set."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ANALYTICS:
        _ANALYTICS[key] = R.analyse(inputs(spark, sf))
    return _ANALYTICS[key]


# --- the same world in SQL ---------------------------------------------------------------------

_RECTANGLE = """
  (6000 + 600 * (n_nationkey % 5)) / 1000::DOUBLE AS w, (50000 + 400 * (n_nationkey // 5)) / 1000::DOUBLE AS s,
  (6600 + 600 * (n_nationkey % 5)) / 1000::DOUBLE AS e, (50400 + 400 * (n_nationkey // 5)) / 1000::DOUBLE AS t,
  (6200 + 600 * (n_nationkey % 5)) / 1000::DOUBLE AS hw, (50100 + 400 * (n_nationkey // 5)) / 1000::DOUBLE AS hs,
  (6400 + 600 * (n_nationkey % 5)) / 1000::DOUBLE AS he, (50300 + 400 * (n_nationkey // 5)) / 1000::DOUBLE AS ht"""


def sql_lattice(key: str, west: int = 5950, width: int = 3101, south: int = 49950, height: int = 2101) -> tuple[str, str]:
    return f"({west} + ({key} * 7919) % {width})", f"({south} + ({key} * 104729) % {height})"


def sql_utm(source: str, name: str, pairs: list[tuple[str, str, str, str]]) -> str:
    """CTEs adding projected columns for ``(lon, lat, x, y)`` pairs, written from the textbook series."""
    text, current = [], source
    for i, (lon, lat, x, y) in enumerate(pairs):
        a, b, c = f"{name}_a{i}", f"{name}_b{i}", f"{name}_c{i}"
        out = name if i == len(pairs) - 1 else f"{name}_{i}"
        east = " + ".join(f"{ALPHA[j]!r} * cos({2 * (j + 1)} * _xi) * sinh({2 * (j + 1)} * _eta)" for j in range(4))
        north = " + ".join(f"{ALPHA[j]!r} * sin({2 * (j + 1)} * _xi) * cosh({2 * (j + 1)} * _eta)" for j in range(4))
        text.append(
            f"{a} AS (SELECT *, sin(radians({lat})) AS _s, radians({lon} - 9.0::DOUBLE) AS _d FROM {current}),\n"
            f"{b} AS (SELECT *, sinh(atanh(_s) - {ECCENTRICITY!r}::DOUBLE * atanh({ECCENTRICITY!r}::DOUBLE * _s)) AS _t FROM {a}),\n"
            f"{c} AS (SELECT *, atan2(_t, cos(_d)) AS _xi, atanh(sin(_d) / sqrt(1 + _t * _t)) AS _eta FROM {b}),\n"
            f"{out} AS (SELECT * EXCLUDE (_s, _d, _t, _xi, _eta),\n"
            f"  500000 + {SCALE * RECTIFYING!r}::DOUBLE * (_eta + {east}) AS {x},\n"
            f"  {SCALE * RECTIFYING!r}::DOUBLE * (_xi + {north}) AS {y} FROM {c})"
        )
        current = out
    return ",\n".join(text)


_AX, _AY = sql_lattice("k", 6000, 2801, 50000, 1801)
_SX, _SY = sql_lattice("k")
_CLASSES = "[" + ", ".join("NULL" if c is None else f"'{c}'" for c in ROAD_CLASSES) + "]"
_TAGS = "[" + ", ".join("NULL" if c is None else f"'{c}'" for c in VOLTAGE_TAGS) + "]"
# What each tag means, stated by hand: the tag list is fixed, the parser is not repeated here.
_TAG_KV = "[110.0, 110.0, 380.0, 110.0, NULL, NULL, NULL, NULL, 20.0]"
_ASSETS = "[" + ", ".join(f"'{a}'" for a in ASSETS) + "]"
_TECH = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TECHNOLOGIES.items()) + " END"

INSIDE = "lon BETWEEN w AND e AND lat BETWEEN s AND t AND NOT (holed AND lon > hw AND lon < he AND lat > hs AND lat < ht)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "d": ((), f"d AS (SELECT n_nationkey AS n, 'DEA' || lpad(n_nationkey::VARCHAR, 2, '0') AS nuts_code, '05' || lpad(n_nationkey::VARCHAR, 3, '0') AS ags, n_name AS district_name, n_nationkey = {HOLE_DISTRICT} AS holed, {_RECTANGLE} FROM nation)"),
    "ring": (("d",), "ring0 AS (SELECT n, 0 AS part, i, CASE WHEN i IN (0, 3) THEN w ELSE e END AS lon, CASE WHEN i < 2 THEN s ELSE t END AS lat FROM d, range(4) r(i) "
             "UNION ALL SELECT n, 1, i, CASE WHEN i IN (0, 3) THEN hw ELSE he END, CASE WHEN i < 2 THEN hs ELSE ht END FROM d, range(4) r(i) WHERE holed),\n"
             + sql_utm("ring0", "ring", [("lon", "lat", "x", "y")])),
    "side": (("ring",), "side AS (SELECT a.n, a.part, a.i, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM ring a JOIN ring b ON a.n = b.n AND a.part = b.part AND b.i = (a.i + 1) % 4)"),
    "dm": (("side", "d"), """mid AS (SELECT n, avg(px) AS mx, avg(py) AS my FROM side GROUP BY n),
dm AS (SELECT d.nuts_code, m.* FROM d JOIN (
  SELECT side.n, sum(sg * c) / 2e6 AS area_km2, any_value(mx) + sum(sg * (px - mx + qx - mx) * c) / (3 * sum(sg * c)) AS cx,
         any_value(my) + sum(sg * (py - my + qy - my) * c) / (3 * sum(sg * c)) AS cy
  FROM (SELECT side.*, mx, my, CASE WHEN part = 0 THEN 1 ELSE -1 END AS sg, (px - mx) * (qy - my) - (qx - mx) * (py - my) AS c FROM side JOIN mid USING (n)) side
  GROUP BY side.n) m USING (n))"""),
    "st": ((), f"st AS (SELECT k, 's' || k::VARCHAR AS source_id, CASE WHEN k % 11 <> 0 THEN 1 + k % 4 END AS charging_points, (k % 13) * 25.0::DOUBLE AS power_kw, "
           f"CASE WHEN k % 7 <> 0 THEN (k % 13) * 12.5::DOUBLE + 1 END AS max_point_power_kw, {_SX} / 1000::DOUBLE AS lon, {_SY} / 1000::DOUBLE AS lat FROM (SELECT o_orderkey AS k FROM orders))"),
    "owner": (("st", "d"), f"owner AS (SELECT source_id, any_value(charging_points) AS charging_points, any_value(max_point_power_kw) AS max_point_power_kw, min(nuts_code) AS nuts_code FROM st JOIN d ON {INSIDE} GROUP BY source_id)"),
    "st_m": (("st",), sql_utm("st", "st_m", [("lon", "lat", "x", "y")])),
    "near_st": (("st_m", "dm"), "near_st AS (SELECT nuts_code, min(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS distance_m FROM dm, st_m GROUP BY nuts_code)"),
    "road": ((), f"road0 AS (SELECT k, {_AX} AS ax, {_AY} AS ay FROM (SELECT c_custkey AS k FROM customer)),\n"
             "road1 AS (SELECT *, ax + (k % 7) * 20 + 10 AS bx, ay + (k % 11) * 15 - 60 AS bz FROM road0),\n"
             f"road AS (SELECT k, 'r' || k::VARCHAR AS osm_id, {_CLASSES}[k % 8 + 1] AS road_class, ' A' || (k % 37)::VARCHAR AS road_number, CASE WHEN k % 9 <> 0 THEN (k % 50) * 200.0::DOUBLE END AS traffic_total, "
             "ax, ay, bx, bz, bx + (k % 5) * 30 - 60 AS cx, bz + (k % 3) * 40 AS cy FROM road1)"),
    "road_seg": (("road",), "road_seg0 AS (SELECT osm_id AS id, traffic_total AS weight, ax / 1000::DOUBLE AS ax, ay / 1000::DOUBLE AS ay, bx / 1000::DOUBLE AS bx, bz / 1000::DOUBLE AS bz FROM road "
                 "UNION ALL SELECT osm_id, traffic_total, bx / 1000::DOUBLE, bz / 1000::DOUBLE, cx / 1000::DOUBLE, cy / 1000::DOUBLE FROM road),\n"
                 + sql_utm("road_seg0", "road_seg", [("ax", "ay", "pax", "pay"), ("bx", "bz", "pbx", "pby")])),
    "g": ((), f"g0 AS (SELECT k, {_AX} AS ax, {_AY} AS ay FROM (SELECT p_partkey AS k FROM part)),\n"
          f"g AS (SELECT k, 'g' || k::VARCHAR AS source_id, {_ASSETS}[k % 5 + 1] AS asset_type, {_TAGS}[k % 9 + 1] AS voltage, {_TAG_KV}[k % 9 + 1]::DOUBLE AS kv, "
          "ax / 1000::DOUBLE AS ax, ay / 1000::DOUBLE AS ay, (ax + (k % 13) * 15 + 5) / 1000::DOUBLE AS bx, (ay + (k % 17) * 10 - 40) / 1000::DOUBLE AS bz FROM g0)"),
    "line_seg": (("g",), "line_seg0 AS (SELECT source_id AS id, kv AS weight, ax, ay, bx, bz FROM g WHERE k % 5 < 3),\n"
                 + sql_utm("line_seg0", "line_seg", [("ax", "ay", "pax", "pay"), ("bx", "bz", "pbx", "pby")])),
    "sub": (("g",), "sub0 AS (SELECT source_id, kv, ax AS lon, ay AS lat FROM g WHERE k % 5 >= 3),\n" + sql_utm("sub0", "sub", [("lon", "lat", "x", "y")])),
    "re": ((), f"re AS (SELECT k, 'e' || k::VARCHAR AS source_id, {_TECH} AS technology, CASE WHEN k % 17 <> 0 THEN value END AS capacity_mw, "
           f"CASE WHEN k % 10 = 0 THEN '' WHEN k % 5 = 0 THEN 'Stillgelegt' ELSE 'In Betrieb' END AS status, {_SX} / 1000::DOUBLE AS lon, {_SY} / 1000::DOUBLE AS lat FROM (SELECT event_id AS k, * FROM events))"),
    "pop": ((), "pop AS (SELECT c_nationkey AS n, (count(*) * 1000 + 17) AS population FROM customer GROUP BY c_nationkey)"),
    "panel": ((), "panel AS (SELECT p.*, s_nationkey AS n, 'DEA' || lpad(s_nationkey::VARCHAR, 2, '0') AS nuts_code, lpad(m::VARCHAR, 8, '0') AS ags FROM "
              "(SELECT l_suppkey AS m, year(l_shipdate) AS year, sum(l_quantity) AS quantity, sum(l_partkey)::DOUBLE AS parts, count(*)::DOUBLE AS rows FROM lineitem GROUP BY 1, 2) p JOIN supplier ON m = s_suppkey)"),
    "con": (("panel",), "con AS (SELECT year, nuts_code, ags, CASE WHEN (m + year) % 31 <> 0 THEN CASE WHEN n = 5 THEN 0 ELSE quantity END END AS gwh FROM panel WHERE (m * 7 + year) % 29 <> 0)"),
    "bal": (("panel",), "bal AS (SELECT year, nuts_code, ags, CASE WHEN (m * 3 + year) % 37 <> 0 THEN parts END AS gen, m % 3 AS unknown, CASE WHEN n % 7 = 3 THEN 0 ELSE rows END AS wind, "
            "CASE WHEN m % 19 <> 0 THEN rows * 2 END AS cap, CASE WHEN (m * 5 + year) % 41 <> 0 THEN rows / 4 END AS addition FROM panel)"),
    "prop": ((), f"prop AS (SELECT k::VARCHAR AS id, k, CASE WHEN k % 23 = 0 THEN ' ' ELSE ' Proposal ' || k::VARCHAR END AS name, p AS charging_points, p * 10.0::DOUBLE AS power_kw, "
             f"CASE WHEN k % 29 <> 0 THEN CASE WHEN k % 31 = 0 THEN p * 11.0::DOUBLE ELSE p * 5.0::DOUBLE END END AS max_point_power_kw, user_id, ts AS created_at, {_SX} / 1000::DOUBLE AS lon, {_SY} / 1000::DOUBLE AS lat "
             "FROM (SELECT event_id AS k, user_id, ts, json_extract_string(props, '$.k')::INTEGER AS p FROM events WHERE event_type = 'signup'))"),
}


def clip_ctes(segments: str, name: str) -> str:
    """CTEs ``<name>(n, id, weight, km)``: Liang-Barsky for the meeting, half planes for the length."""
    def axis(a: str, b: str, lo: str, hi: str) -> tuple[str, str, str]:
        enter = f"CASE WHEN {b} <> {a} THEN least(({lo} - {a}) / ({b} - {a}), ({hi} - {a}) / ({b} - {a})) ELSE 0 END"
        leave = f"CASE WHEN {b} <> {a} THEN greatest(({lo} - {a}) / ({b} - {a}), ({hi} - {a}) / ({b} - {a})) ELSE 1 END"
        return enter, leave, f"({b} <> {a} OR {a} BETWEEN {lo} AND {hi})"

    ex, lx, okx = axis("ax", "bx", "w", "e")
    ey, ly, oky = axis("ay", "bz", "s", "t")
    swallowed = "(holed AND least(ax, bx) > hw AND greatest(ax, bx) < he AND least(ay, bz) > hs AND greatest(ay, bz) < ht)"
    return f"""{name}_meet AS (
  SELECT DISTINCT n, id FROM {segments}, d
  WHERE {okx} AND {oky} AND greatest(0, {ex}, {ey}) <= least(1, {lx}, {ly}) + 1e-9 AND NOT {swallowed}),
{name}_f AS (
  SELECT n, part, id, pax, pay, pbx, pby, (qx - px) * (pay - py) - (qy - py) * (pax - px) AS fa, (qx - px) * (pby - py) - (qy - py) * (pbx - px) AS fb
  FROM {segments}, side),
{name}_part AS (
  SELECT n, part, id, pax, pay, pbx, pby, bool_or(fa < 0 AND fb < 0) AS out,
         max(CASE WHEN fa < 0 AND fb >= 0 THEN fa / (fa - fb) ELSE 0 END) AS t0, min(CASE WHEN fa >= 0 AND fb < 0 THEN fa / (fa - fb) ELSE 1 END) AS t1
  FROM {name}_f GROUP BY ALL),
{name}_len AS (
  SELECT n, id, sum(CASE WHEN out OR t1 <= t0 THEN 0 ELSE (CASE WHEN part = 0 THEN 1 ELSE -1 END) * (t1 - t0) * sqrt((pbx - pax) * (pbx - pax) + (pby - pay) * (pby - pay)) END) / 1000 AS km
  FROM {name}_part GROUP BY n, id),
{name}_w AS (SELECT id, any_value(weight) AS weight FROM {segments} GROUP BY id),
{name} AS (SELECT m.n, m.id, weight, coalesce(km, 0) AS km FROM {name}_meet m LEFT JOIN {name}_len USING (n, id) JOIN {name}_w USING (id))"""


def near_segments(segments: str, name: str) -> str:
    """CTE ``<name>(nuts_code, distance_m)``: nearest segment of each district centroid."""
    return f"""{name} AS (
  SELECT nuts_code, min(sqrt((cx - pax - tt * dx) ** 2 + (cy - pay - tt * dy) ** 2)) AS distance_m FROM (
    SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, ((cx - pax) * dx + (cy - pay) * dy) / (dx * dx + dy * dy))) END AS tt
    FROM (SELECT nuts_code, cx, cy, pax, pay, pbx - pax AS dx, pby - pay AS dy FROM dm, {segments})) GROUP BY nuts_code)"""


CTES["rclip"] = (("road_seg", "side", "d"), clip_ctes("road_seg", "rclip"))
CTES["lclip"] = (("line_seg", "side", "d"), clip_ctes("line_seg", "lclip"))
CTES["near_road"] = (("road_seg", "dm"), near_segments("road_seg", "near_road"))
CTES["near_sub"] = (("sub", "dm"), "near_sub AS (SELECT nuts_code, min(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS distance_m FROM dm, sub GROUP BY nuts_code)")


def sql(final: str, *needs: str, extra: str = "") -> str:
    """A query over the named CTEs (with what they need) and extra CTEs of its own."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for parent in CTES[name][0]:
                visit(parent)
            order.append(name)

    for name in needs:
        visit(name)
    parts = [CTES[name][1] for name in order] + ([extra] if extra else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final


def normalized(metric: str, low: str, high: str, inverse: bool = False) -> str:
    scaled = f"100.0::DOUBLE * (least(greatest({metric}, {low}), {high}) - {low}) / nullif({high} - {low}, 0)"
    value = f"100.0::DOUBLE - {scaled}" if inverse else scaled
    return (
        f"round((CASE WHEN {metric} IS NULL OR {low} IS NULL OR {high} IS NULL THEN NULL WHEN {high} = {low} THEN 50 ELSE {value} END)::DECIMAL(20, 13), 1)::DECIMAL(5, 1)"
    )
