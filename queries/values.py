"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import world as W
from queries.registry import big, query, r
from queries.world import normalized, sql
from regionscore.functions import parsing as X
from regionscore.functions import scores as SC
from regionscore.operators import rollups as RU


def _pick(key, values, kind="string"):
    """The value a key selects from a list."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), (key % len(values)).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _numbers(values) -> str:
    return "CAST([" + ", ".join("NULL" if v is None else repr(v) for v in values) + "] AS DOUBLE[])"


@query("normalized_prices", (
    f"SELECT o_orderkey, {normalized('m', '50000::DOUBLE', '400000::DOUBLE')}::DOUBLE AS score, {normalized('m', '50000::DOUBLE', '400000::DOUBLE', True)}::DOUBLE AS inverse_score, "
    f"{normalized('m', '7::DOUBLE', '7::DOUBLE')}::DOUBLE AS flat_score FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 4 THEN o_totalprice END AS m FROM orders)"))
def normalized_prices(spark, sf):
    m = F.when(F.col("o_orderkey") % 9 != 4, F.col("o_totalprice"))
    low, high = F.lit(50000.0), F.lit(400000.0)
    s = lambda c: SC.round_score(c).cast("double")
    return W.table(spark, sf, "orders").select(
        "o_orderkey",
        s(SC.normalize_5_95(m, low, high)).alias("score"),
        s(SC.normalize_5_95(m, low, high, True)).alias("inverse_score"),
        s(SC.normalize_5_95(m, F.lit(7.0), F.lit(7.0))).alias("flat_score"),
    )


@query("normalized_prices_in_sql", (
    f"SELECT o_orderkey, round({normalized('o_totalprice', '50000::DOUBLE', '400000::DOUBLE')}::DOUBLE, 1) AS score, CASE WHEN o_orderpriority LIKE '1%' THEN 'motorway' ELSE lower(o_orderpriority) END AS road_class FROM orders"))
def normalized_prices_in_sql(spark, sf):
    """The same functions registered for SQL text."""
    SC.register_sql_functions(spark)
    W.table(spark, sf, "orders").createOrReplaceTempView("regionscore_orders")
    return spark.sql(
        "SELECT o_orderkey, cast(round(cast(normalize_5_95(o_totalprice, 50000D, 400000D) AS decimal(20, 13)), 1) AS double) AS score, "
        "normalize_road_class(CASE WHEN o_orderpriority LIKE '1%' THEN ' a' ELSE o_orderpriority END) AS road_class FROM regionscore_orders"
    )


@query("road_classes", sql("SELECT osm_id, CASE WHEN upper(trim(road_class)) = 'A' THEN 'motorway' WHEN upper(trim(road_class)) = 'B' THEN 'primary' WHEN upper(trim(road_class)) = 'L' THEN 'secondary' WHEN upper(trim(road_class)) = 'K' THEN 'tertiary' ELSE nullif(lower(trim(road_class)), '') END AS class FROM road", "road"))
def road_classes(spark, sf):
    return W.roads(spark, sf).select("osm_id", X.road_class(F.col("road_class")).alias("class"))


@query("voltage_tags", """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN v / 1000 WHEN 2 THEN v / 1000 WHEN 3 THEN (v + 7000) / 1000 WHEN 4 THEN NULL WHEN 5 THEN v / 1000 WHEN 6 THEN NULL ELSE (v + 500) / 1000 END AS kv
FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 380 + 1) * 1000.0::DOUBLE AS v FROM lineitem)""")
def voltage_tags(spark, sf):
    """Tags written from the part key, in the form that the line number picks."""
    volts = (F.col("l_partkey") % 380 + 1) * 1000
    v, kv = volts.cast("string"), (volts / 1000).cast("int").cast("string")
    more, half = (volts + 7000).cast("string"), ((volts + 500) / 1000).cast("string")
    forms = {1: v, 2: F.concat(kv, F.lit(" KV")), 3: F.concat(v, F.lit("; "), more), 4: F.concat(F.lit("-"), v), 5: F.concat(F.lit("none;"), kv, F.lit("kv;0")), 6: F.concat(F.lit("ca. "), v)}
    tag = F.concat(half, F.lit(" kV"))
    for line, form in forms.items():
        tag = F.when(F.col("l_linenumber") == line, form).otherwise(tag)
    return W.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.voltage_kv(tag).alias("kv"))


_NAMES = ("Köln, kreisfreie Stadt", "Mülheim a.d. Ruhr", "  Düren ", "Rhein-Sieg-Kreis", "Große Aue", "Ærø Ñandú 2²", None, "Bonn , Kreisfreie  Stadt")
_KEYS = ("koln", "mulheimanderruhr", "duren", "rheinsiegkreis", "groeaue", "rnandu22", "", "bonn")


@query("district_keys", f"SELECT o_orderkey, {_list(_KEYS)}[o_custkey % {len(_NAMES)} + 1] AS key FROM orders")
def district_keys(spark, sf):
    return W.table(spark, sf, "orders").select("o_orderkey", X.district_key(_pick(F.col("o_custkey"), _NAMES)).alias("key"))


_DECIMALS = ("7,1", "51.2", " 3 ", "NaN", "Infinity", "-1", "", None, "invalid", "1e3", "1.5d", "0")
_VALUES = (7.1, 51.2, 3.0, None, None, -1.0, None, None, None, 1000.0, None, 0.0)
_COUNTS = (7, 51, 3, 1, 1, -1, 1, 1, 1, 1000, 1, 1)


@query("decimal_readings", f"SELECT event_id, {_numbers(_VALUES)}[event_id % 12 + 1] AS value, CAST({list(_COUNTS)} AS BIGINT[])[event_id % 12 + 1] AS points FROM events")
def decimal_readings(spark, sf):
    text = _pick(F.col("event_id"), _DECIMALS)
    return W.table(spark, sf, "events").select(
        "event_id", X.decimal_comma(text).alias("value"), X.point_count(text).cast("bigint").alias("points")
    )


@query("connector_powers", "SELECT l_orderkey, l_linenumber, m AS maximum, CASE WHEN m >= 50 THEN 'fast' WHEN m IS NOT NULL THEN 'normal' END AS class FROM (SELECT l_orderkey, l_linenumber, nullif(greatest(l_quantity, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_quantity + 10 END, 0) * (l_suppkey % 2), 0) AS m FROM lineitem)")
def connector_powers(spark, sf):
    on = F.col("l_suppkey") % 2 == 1
    q = F.col("l_quantity")
    readings = [
        F.when(on, F.replace(q.cast("string"), F.lit("."), F.lit(","))).otherwise(F.lit("-11")),
        F.when(on & (F.col("l_partkey") % 3 != 0), (q + 10).cast("string")).otherwise("NaN"),
        F.lit("invalid"),
        F.lit(""),
        F.lit("0"),
        F.lit(None).cast("string"),
    ]
    m = X.max_point_power(readings)
    return W.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", m.alias("maximum"), X.power_class(m).alias("class"))


@query("traffic_observations", """SELECT o_orderkey,
  CASE WHEN p IS NULL AND a > 0 THEN a END AS total, CASE WHEN p IS NULL AND a > 0 AND NOT (l = 0 AND h = 0) THEN l END AS light, CASE WHEN p IS NULL AND a > 0 AND NOT (l = 0 AND h = 0) THEN h END AS heavy, p AS problem
FROM (SELECT o_orderkey, k * 100.0::DOUBLE AS a, CASE WHEN k % 5 = 1 THEN 0 ELSE k * 60.0::DOUBLE END AS l, CASE WHEN k % 5 IN (1, 2) THEN 0 WHEN k % 5 = 3 AND k > 0 THEN -1 ELSE k * 40.0::DOUBLE END AS h,
  CASE WHEN k = 0 AND o_custkey % 2 = 0 THEN 'zero all-days total with a positive day-type total' WHEN k > 0 AND k % 5 = 3 THEN 'DTVSVA must not be negative' END AS p
  FROM (SELECT o_orderkey, o_custkey, o_custkey % 20 // 1 AS c, (o_orderkey % 10) AS k FROM orders))""")
def traffic_observations(spark, sf):
    k, odd = F.col("o_orderkey") % 10, F.col("o_custkey") % 2
    totals = {
        "DTVKFZA": k * 100.0,
        "DTVKFZW": F.when(k == 0, F.when(odd == 0, 5.0).otherwise(0.0)).otherwise(k * 110.0),
        "DTVKFZU": F.lit(None).cast("double"),
        "DTVKFZS": k * 70.0,
    }
    light = F.when(k % 5 == 1, 0.0).otherwise(k * 60.0)
    heavy = F.when((k % 5).isin(1, 2), 0.0).when((k % 5 == 3) & (k > 0), -1.0).otherwise(k * 40.0)
    t = W.table(spark, sf, "orders").select("o_orderkey", X.traffic_observation(totals, light, heavy).alias("t"))
    return t.select("o_orderkey", "t.*")


_DATES = ("Letzte Aktualisierung vom: 22.04.2026;;;", "letzte  aktualisierung  vom:31.12.2025", "Letzte Aktualisierung vom: 31.02.2026", "Letzte Aktualisierung vom: 2026-04-22", "Ladesaeulenregister", None)
_ISO = ("2026-04-22", "2025-12-31", None, None, None, None)


@query("publication_dates", f"SELECT doc_id, {_list(_ISO)}[doc_id % 6 + 1]::DATE AS published FROM documents")
def publication_dates(spark, sf):
    return W.table(spark, sf, "documents").select("doc_id", X.publication_date(_pick(F.col("doc_id"), _DATES)).alias("published"))


@query("padded_keys", "SELECT l_orderkey, l_linenumber, CASE WHEN length(k) < 8 THEN lpad(k, 8, '0') ELSE k END AS ags FROM (SELECT l_orderkey, l_linenumber, (l_partkey * l_partkey * 1000003)::VARCHAR AS k FROM lineitem)")
def padded_keys(spark, sf):
    k = F.col("l_partkey")
    return W.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.pad_ags(k * k * 1000003).alias("ags"))


@query("first_texts", "SELECT page_id, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN url END, ''), CASE WHEN page_id % 2 = 0 THEN 'second' END, '-') AS text FROM pages")
def first_texts(spark, sf):
    k = F.col("page_id")
    first = F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("url"))
    return W.table(spark, sf, "pages").select("page_id", X.first_text(first, F.when(k % 2 == 0, "second"), default="-").alias("text"))


@query("valid_coordinates", "SELECT event_id, coalesce(NOT isnan(lon) AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90, false) AS valid FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 <> 0 THEN value * 10 - 200 END AS lon, value * 5 - 100 AS lat FROM events)")
def valid_coordinates(spark, sf):
    k = F.col("event_id")
    lon = F.when(k % 7 == 0, float("nan")).when(k % 11 != 0, F.col("value") * 10 - 200)
    return W.table(spark, sf, "events").select("event_id", X.valid_coordinates(lon, F.col("value") * 5 - 100).alias("valid"))


@query("identifier_patterns", "SELECT doc_id, doc_id % 4 < 2 AS is_uuid, true AS is_sha256, CASE WHEN doc_id % 4 < 2 THEN lpad(to_hex(doc_id), 8, '0') || '-0000-4000-8000-000000000001' END AS feature_uuid FROM documents")
def identifier_patterns(spark, sf):
    k = F.col("doc_id")
    uuid = F.concat(F.format_string("%08X", k), F.lit("-0000-4000-8000-000000000001"))
    text = F.when(k % 4 < 2, uuid).when(k % 4 == 2, F.replace(uuid, F.lit("-4000-"), F.lit("-0000-"))).otherwise("x")
    return W.table(spark, sf, "documents").select(
        "doc_id",
        X.is_uuid(text).alias("is_uuid"),
        X.is_sha256(F.sha2("text", 256)).alias("is_sha256"),
        X.uuid_of_feature(F.concat(F.lit("proposed_chargers."), text)).alias("feature_uuid"),
    )


@query("technology_labels", "SELECT event_id, CASE event_type WHEN 'view' THEN 'Wind energy' WHEN 'click' THEN 'Ground-mounted solar' WHEN 'purchase' THEN 'Rooftop solar' WHEN 'signup' THEN 'Biomass' ELSE 'Sewage gas' END AS label, CASE WHEN event_type IN ('click', 'purchase') THEN 'solar' ELSE 'wind' END AS technology_group FROM events")
def technology_labels(spark, sf):
    t = W.renewables(spark, sf)
    return t.select(F.col("k").alias("event_id"), X.technology_label(F.col("technology")).alias("label"), X.technology_group(F.col("technology")).alias("technology_group"))


@query("score_bins", "SELECT event_id, CASE WHEN s < 35 THEN '<35' WHEN s < 50 THEN '35-<50' WHEN s < 65 THEN '50-<65' WHEN s < 80 THEN '65-<80' WHEN s IS NOT NULL THEN '80-100' END AS bin, CASE WHEN c >= 10 THEN '+10 or more' WHEN c > 0 THEN '0 to +10' WHEN c = 0 THEN 'No change' WHEN c > -10 THEN '-10 to 0' WHEN c IS NOT NULL THEN '-10 or less' END AS change, "
       "CASE WHEN c > 0 THEN 'increase' WHEN c < 0 THEN 'decrease' WHEN c = 0 THEN 'unchanged' END AS direction, CASE WHEN s IS NOT NULL THEN event_id END AS shown_rank FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_id % 101 END AS s, event_id % 41 - 20 AS c FROM events)")
def score_bins(spark, sf):
    k = F.col("event_id")
    s, c = F.when(k % 5 != 0, k % 101), k % 41 - 20
    return W.table(spark, sf, "events").select(
        "event_id", SC.score_bin(s).alias("bin"), SC.change_bin(c).alias("change"), SC.change_direction(c).alias("direction"), SC.published_rank(s, k).alias("shown_rank")
    )


@query("formatted_values", "SELECT event_id, CASE WHEN v > 0 THEN '+' ELSE '' END || printf('%.1f', v) AS signed, regexp_replace(printf('%.1f', v * 10), '\\.0$', '') || '%' AS coverage FROM (SELECT event_id, (event_id % 401 - 200) / 10::DOUBLE AS v FROM events)")
def formatted_values(spark, sf):
    v = (F.col("event_id") % 401 - 200) / 10.0
    t = W.table(spark, sf, "events").select("event_id", v.alias("v"))
    return t.select("event_id", SC.signed_value(F.col("v")).alias("signed"), SC.coverage_percentage(F.col("v") / 10).alias("coverage"))


@query("grid_keys", sql("SELECT source_id, floor(lon / 0.45::DOUBLE)::BIGINT::VARCHAR || ':' || floor(lat / 0.45::DOUBLE)::BIGINT::VARCHAR AS cell FROM st", "st"))
def grid_keys(spark, sf):
    return W.stations(spark, sf).select("source_id", X.grid_key(F.col("lon"), F.col("lat"), 0.45).alias("cell"))


@query("stale_snapshots", "SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-06-01' - INTERVAL 30 DAY AS stale FROM orders")
def stale_snapshots(spark, sf):
    now = F.lit("1998-06-01 00:00:00").cast("timestamp")
    return W.table(spark, sf, "orders").select("o_orderkey", X.is_stale(F.col("o_orderdate").cast("timestamp"), now).alias("stale"))


@query("technology_sums", "SELECT l_orderkey, l_linenumber, a + b AS capacity, CASE WHEN u = 0 THEN coalesce(y1, 0) + coalesce(y2, 0) END AS yield, u AS unknown FROM (SELECT *, (y1 IS NULL AND coalesce(a, 1) <> 0)::INTEGER + (y2 IS NULL AND coalesce(b, 1) <> 0)::INTEGER AS u FROM ("
       "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 4 * 1.0::DOUBLE END AS a, l_suppkey % 3 * 1.0::DOUBLE AS b, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END AS y1, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity * 2 END AS y2 FROM lineitem))")
def technology_sums(spark, sf):
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    t = W.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(p % 7 != 0, p % 4 * 1.0).alias("Wind: Leistung (MW)"),
        (s % 3 * 1.0).alias("Biomasse: Leistung (MW)"),
        F.when(p % 3 != 0, q).alias("Wind: Stromertrag (MWh)"),
        F.when(s % 2 == 0, q * 2).alias("Biomasse: Stromertrag (MWh)"),
    )
    total, unknown = RU.sum_yield(t, ["Wind: Stromertrag (MWh)", "Biomasse: Stromertrag (MWh)", "Absent: Stromertrag (MWh)"])
    capacity = RU.sum_known(t, ["Wind: Leistung (MW)", "Biomasse: Leistung (MW)", "Absent: Leistung (MW)"])
    return t.select("l_orderkey", "l_linenumber", capacity.alias("capacity"), total.alias("yield"), unknown.alias("unknown"))


@query("gated_supplier_totals", "SELECT l_suppkey, CASE WHEN count(*) FILTER (WHERE l_returnflag <> 'A') = count(*) THEN sum(l_quantity) END AS total, round(count(*) FILTER (WHERE l_returnflag <> 'A') / count(*)::DOUBLE, 9) AS coverage FROM lineitem GROUP BY l_suppkey")
def gated_supplier_totals(spark, sf):
    """A sum is published only where everything expected was reported."""
    g = W.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("s"), F.count_if(F.col("l_returnflag") != "A").alias("reported"), F.count("*").alias("expected")
    )
    return g.select(
        "l_suppkey",
        RU.gated_sum(F.col("s"), F.col("reported"), F.col("expected")).alias("total"),
        r(SC.ratio(F.col("reported"), F.col("expected")), 9).alias("coverage"),
    )
