"""Keyed table operators, quality checks, sources, sinks, provenance and the proposal feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import analysis as _analysis  # noqa: F401  (defines shared CTEs)
from queries import world as W
from queries.registry import big, query, r
from queries.world import CTES, INSIDE, sql
from regionscore.operators import quality as Q
from regionscore.operators import relational as RL
from regionscore.plans import scenario as SC
from regionscore.sinks import export as EX
from regionscore.sinks import provenance as PV
from regionscore.sources import features as SF
from regionscore.sources import inventory as IN
from regionscore.sources import tables as ST
from regionscore.storage import materialize, new_path
from regionscore.streaming.proposals import FEED_SCHEMA, start_proposal_feed, stored_proposals


@query("population_by_either_code", sql(
    "SELECT d.nuts_code, p.population FROM d LEFT JOIN pop p ON p.n = d.n", "d", "pop"))
def population_by_either_code(spark, sf):
    p = W.population(spark, sf).withColumn("row_id", F.col("district_code"))
    joined = RL.left_join_any(
        W.districts(spark, sf).select("nuts_code", "ags"), p, [("nuts_code", "nuts_code"), ("ags", "ags")], left_id="nuts_code", right_id="row_id"
    )
    return joined.select("nuts_code", big("population"))


@query("supplier_or_nation_matches", "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey OR s_nationkey = c_custkey")
def supplier_or_nation_matches(spark, sf):
    """Disjunctive left join where a left row may meet many right rows."""
    return RL.left_join_any(
        W.table(spark, sf, "customer").select("c_custkey"),
        W.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"),
        [("c_custkey", "s_suppkey"), ("c_custkey", "s_nationkey")],
        left_id="c_custkey",
        right_id="s_suppkey",
    ).select("c_custkey", "s_suppkey")


def _versions(spark, sf):
    o = W.table(spark, sf, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    current = o.where(k % 10 != 1).select("o_orderkey", "o_orderstatus", price.alias("price"))
    incoming = o.where(k % 10 != 2).select(
        "o_orderkey", F.when(k % 10 == 4, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 10 == 3, price + 1).otherwise(price).alias("price"),
    )
    return current, incoming


@query("snapshot_sync_diff", "SELECT o_orderkey, CASE o_orderkey % 10 WHEN 1 THEN 'inserted' WHEN 2 THEN 'deleted' WHEN 3 THEN 'updated' WHEN 4 THEN 'updated' ELSE 'unchanged' END AS action FROM orders")
def snapshot_sync_diff(spark, sf):
    return RL.sync_snapshot(*_versions(spark, sf), ["o_orderkey"])[1]


@query("snapshot_next_state", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 4 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 10 <> 2")
def snapshot_next_state(spark, sf):
    return RL.sync_snapshot(*_versions(spark, sf), ["o_orderkey"])[0]


@query("panel_sync_diff", sql("SELECT year, ags, CASE WHEN year = 1997 THEN 'deleted' WHEN gwh IS NULL THEN 'updated' ELSE 'unchanged' END AS action FROM con", "con"))
def panel_sync_diff(spark, sf):
    """The same on a two-column key."""
    now = W.consumption(spark, sf).select("year", "ags", "consumption_gwh")
    incoming = now.where("year <> 1997").withColumn("consumption_gwh", F.coalesce("consumption_gwh", F.lit(-1.0)))
    return RL.sync_snapshot(now, incoming, ["year", "ags"])[1]


@query("rows_absent_from_incoming", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 2")
def rows_absent_from_incoming(spark, sf):
    return RL.rows_absent_from(*_versions(spark, sf), ["o_orderkey"]).select("o_orderkey")


@query("key_differences", "SELECT c_custkey, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def key_differences(spark, sf):
    seen = W.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return RL.key_differences(W.table(spark, sf, "customer").select("c_custkey"), seen, "c_custkey")


@query("blank_to_null", sql("SELECT source_id, nullif(voltage, '') AS voltage, asset_type FROM g", "g"))
def blank_to_null(spark, sf):
    return RL.blank_to_null(W.grid(spark, sf), ["voltage", "asset_type"]).select("source_id", "voltage", "asset_type")


@query("typed_staging", "SELECT event_id, value, CASE WHEN event_id % 4 <> 0 THEN event_id % 50 END::INTEGER AS points FROM events")
def typed_staging(spark, sf):
    from pyspark.sql import types as T

    text = W.table(spark, sf, "events").select(
        "event_id", F.col("value").cast("string").alias("value"), F.when(F.col("event_id") % 4 == 0, "x").otherwise((F.col("event_id") % 50).cast("string")).alias("points")
    )
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("points", T.IntegerType())])
    return RL.try_cast_to(text, schema)


@query("first_order_of_customer", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_order_of_customer(spark, sf):
    return RL.first_by_order(W.table(spark, sf, "orders"), "o_custkey", "o_orderkey")[0].select("o_custkey", "o_orderkey")


@query("last_order_of_customer", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def last_order_of_customer(spark, sf):
    return RL.last_by_order(W.table(spark, sf, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("lowest_owner", "SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_partkey")
def lowest_owner(spark, sf):
    return RL.lowest_owner(W.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return Q.duplicate_keys(W.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("pruned_columns", "SELECT n_nationkey, n_name FROM nation")
def pruned_columns(spark, sf):
    t = W.table(spark, sf, "nation").withColumns({"empty": F.lit(None).cast("string"), "n_regionkey": F.array("n_regionkey")})
    return RL.prune_columns(t)


def _register(spark, sf):
    """Station records with repeated ids and bad positions: every seventh record reuses an id."""
    s = W.stations(spark, sf)
    k = F.col("k")
    lon = F.when(k % 17 == 0, float("nan")).when(k % 19 == 0, 400.0).otherwise(F.col("lon"))
    return s.select(
        F.when(k % 7 == 0, k - k % 21).otherwise(k).cast("string").alias("id"), k.alias("ordinal"), F.col("operator").alias("name"), "operator",
        F.lit(None).cast("string").alias("district_text"), lon.alias("lon"), "lat",
    )


CTES["reg"] = (("st",), "reg AS (SELECT CASE WHEN k % 7 = 0 THEN k - k % 21 ELSE k END AS id, k, CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN NULL ELSE lon END AS lon, lat FROM st),\n"
    "reg1 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS rn FROM reg)")
CTES["cls"] = (("reg", "d"), f"cls AS (SELECT id::VARCHAR AS id, k AS ordinal, CASE WHEN rn = 1 AND lon IS NOT NULL THEN code END AS nuts_code, CASE WHEN rn > 1 THEN 'duplicate_id' WHEN lon IS NULL THEN 'invalid_coordinates' WHEN code IS NULL THEN 'outside_nrw' END AS reason FROM (SELECT reg1.id, reg1.k, any_value(rn) AS rn, any_value(reg1.lon) AS lon, min(nuts_code) AS code FROM reg1 LEFT JOIN d ON {INSIDE} GROUP BY reg1.id, reg1.k))")


@query("classified_stations", sql("SELECT * FROM cls", "cls"))
def classified_stations(spark, sf):
    return Q.classify_points(_register(spark, sf), W.prepared(spark, sf).index).select("id", "ordinal", "nuts_code", "reason")


@query("classification_reconciles", sql(
    "SELECT * FROM (VALUES ('accepted plus rejected equals source', 0::BIGINT), ('accepted ids are unique', 0), ('accepted regions are known', 0), ('reject reasons are allowed', 0)) t(\"check\", violations)"))
def classification_reconciles(spark, sf):
    source = _register(spark, sf)
    classified = materialize(Q.classify_points(source, W.prepared(spark, sf).index), "classified")
    accepted, rejected = Q.split_classified(classified)
    return Q.reconcile(source, accepted, rejected, W.prepared(spark, sf).table.select("nuts_code"))


@query("rejected_station_records", sql("SELECT id, reason FROM cls WHERE reason IS NOT NULL", "cls"))
def rejected_station_records(spark, sf):
    _, rejected = Q.split_classified(Q.classify_points(_register(spark, sf), W.prepared(spark, sf).index))
    return rejected.select("id", "reason")


@query("snapshot_guard", "SELECT * FROM (VALUES ('station snapshot is not empty', 0::BIGINT), ('expected number of regions', 28), ('region codes carry the prefix', 0)) t(\"check\", violations)")
def snapshot_guard(spark, sf):
    return Q.snapshot_guard(W.districts(spark, sf), W.stations(spark, sf))


@query("population_problems", sql(
    "SELECT nuts_code, CASE n % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'population' END AS problem FROM d WHERE n % 5 < 3 UNION ALL SELECT 'XX' || lpad(n::VARCHAR, 2, '0'), 'unexpected' FROM d WHERE n % 5 = 4", "d"))
def population_problems(spark, sf):
    n = F.col("c_nationkey").cast("bigint")
    counts = W.table(spark, sf, "customer").groupBy(n.alias("n")).agg(F.count("*").cast("int").alias("c"))
    code = F.format_string("DEA%02d", "n")
    rows = counts.where("n % 5 <> 0").select(
        code.alias("nuts_code"), F.when(F.col("n") % 5 == 2, 0).otherwise(F.col("c")).alias("population"), F.lit(2024).alias("reference_year"), "n"
    )
    again = rows.where("n % 5 = 1")
    strange = rows.where("n % 5 = 4").withColumn("nuts_code", F.format_string("XX%02d", "n"))
    return Q.population_problems(rows.union(again).union(strange).drop("n"), W.districts(spark, sf).select("nuts_code"))


_RULES = {
    "name_length": "trim(name) <> ''",
    "charging_points_range": "charging_points BETWEEN 1 AND 100",
    "power_range": "power_kw BETWEEN 1 AND 1000",
    "max_point_power_required": "max_point_power_kw IS NOT NULL",
    "max_point_power_range": "max_point_power_kw > 0 AND max_point_power_kw <= power_kw",
}
_REASON = "CASE " + " ".join(f"WHEN NOT coalesce({c}, false) THEN '{n}'" for n, c in _RULES.items()) + " END"
CTES["pj"] = (("prop", "d"), f"pj AS (SELECT prop.id, any_value(coalesce({_REASON}, CASE WHEN n IS NULL THEN 'district' END)) AS reason, count(nuts_code) AS hits, min(nuts_code) AS nuts_code FROM prop LEFT JOIN d ON {INSIDE} GROUP BY prop.id),\n"
    "pjv AS (SELECT id, CASE WHEN reason IS NULL AND hits <> 1 THEN 'district' ELSE reason END AS reason, nuts_code FROM pj)")


@query("accepted_proposals", sql("SELECT id, nuts_code, 'proposed' AS status FROM pjv WHERE reason IS NULL", "pj"))
def accepted_proposals(spark, sf):
    return SC.validate_proposals(W.proposals(spark, sf), W.prepared(spark, sf).index)[0].select("id", "nuts_code", "status")


@query("rejected_proposals", sql("SELECT id, reason FROM pjv WHERE reason IS NOT NULL", "pj"))
def rejected_proposals(spark, sf):
    return SC.validate_proposals(W.proposals(spark, sf), W.prepared(spark, sf).index)[1].select("id", "reason")


@query("current_proposals", "SELECT user_id::VARCHAR AS id, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1) WHERE event_type <> 'error'")
def current_proposals(spark, sf):
    """The event log read as inserts and tombstones (errors delete)."""
    log = W.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("id"), F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("op"), F.col("ts").alias("at"), "value"
    )
    return SC.current_proposals(log).select("id", "value")


@query("effective_stations", sql(
    "SELECT 'official:' || source_id AS source_id, power_kw FROM st UNION ALL SELECT 'proposal:' || id, power_kw FROM prop", "st", "prop"))
def effective_stations(spark, sf):
    return SC.effective_stations(W.stations(spark, sf), W.proposals(spark, sf)).select("source_id", "power_kw")


@query("proposal_feed", sql("SELECT id, nuts_code FROM pone", "pok"))
def proposal_feed(spark, sf):
    """The stream run to its end over files in time order; a request id is stored once."""
    folder = new_path(spark, "feed")
    feed = W.proposals(spark, sf)
    feed.select(*[F.col(f.name).cast(f.dataType) for f in FEED_SCHEMA.fields]).repartitionByRange(2, "created_at").sortWithinPartitions(
        "created_at"
    ).write.parquet(f"{folder}/in")
    started = start_proposal_feed(
        spark, f"{folder}/in", f"{folder}/checkpoint", f"{folder}/out", W.prepared(spark, sf).index, once=True
    )
    started.awaitTermination()
    if started.exception():
        raise started.exception()
    return stored_proposals(spark, f"{folder}/out").select("id", "nuts_code")


_REUSED = sql(
    "SELECT unnest(ids) AS id, unnest(requests) AS request_id FROM run WHERE i = (SELECT max(i) FROM run)", "pok",
    extra="""o AS (SELECT row_number() OVER (ORDER BY created_at, id2, request) AS i, id2, request FROM (
  SELECT created_at, 'p' || (k % 211)::VARCHAR AS id2, printf('%08x-0000-4000-8000-%012x', user_id, user_id) AS request FROM pok)),
run AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS ids, []::VARCHAR[] AS requests UNION ALL
  SELECT o.i, CASE WHEN list_contains(ids, id2) OR list_contains(requests, request) THEN ids ELSE list_append(ids, id2) END,
    CASE WHEN list_contains(ids, id2) OR list_contains(requests, request) THEN requests ELSE list_append(requests, request) END
  FROM run JOIN o ON o.i = run.i + 1)""").replace("WITH ", "WITH RECURSIVE ", 1)  # fmt: skip


@query("proposal_feed_with_reused_ids", _REUSED)
def proposal_feed_with_reused_ids(spark, sf):
    """Ids and request ids that come again, in three deliveries: stored as if one by one."""
    folder = new_path(spark, "feed")
    feed = W.proposals(spark, sf).withColumn("id", F.concat(F.lit("p"), (F.col("id").cast("bigint") % 211).cast("string")))
    feed = feed.select(*[F.col(f.name).cast(f.dataType) for f in FEED_SCHEMA.fields])
    at = F.unix_micros("created_at")
    cuts = feed.agg(F.percentile_approx(at, F.array(F.lit(0.33), F.lit(0.66)), 1000)).first()[0] or [0, 0]
    for low, high in ((None, cuts[0]), (cuts[0], cuts[1]), (cuts[1], None)):
        part = feed.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.write.mode("append").parquet(f"{folder}/in")
        started = start_proposal_feed(spark, f"{folder}/in", f"{folder}/checkpoint", f"{folder}/out", W.prepared(spark, sf).index, once=True, merge_every=2)
        started.awaitTermination()
        if started.exception():
            raise started.exception()
    return stored_proposals(spark, f"{folder}/out").select("id", "request_id")


_HASHES = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)::VARCHAR" for i in range(4))


@query("document_content_hash", f"SELECT count(*) AS features, sha256(concat_ws(':', {_HASHES})) AS content_sha256 FROM (SELECT sha256(text) AS h FROM documents)")
def document_content_hash(spark, sf):
    """Whole texts, summed digests: the same however the rows are spread."""
    count, digest = EX.content_hash(F.col("text"))
    return W.table(spark, sf, "documents").agg(count.alias("features"), digest.alias("content_sha256"))


@query("layer_manifest", sql("SELECT 'roads' AS layer, count(*) AS features FROM road UNION ALL SELECT 'renewables', count(*) FROM re", "road", "re"))
def layer_manifest(spark, sf):
    from regionscore.plans.publish import with_point_geometry

    layers = {"roads": W.roads(spark, sf), "renewables": with_point_geometry(W.renewables(spark, sf).drop("lon", "lat", "k").withColumns({"lon": F.lit(7.0), "lat": F.lit(51.0)}))}
    return EX.build_manifest(layers).select("layer", "features")


@query("exported_roads_read_back", sql("SELECT osm_id AS source_id, nullif(road_class, '') AS road_class, ax / 1000::DOUBLE AS x, ay / 1000::DOUBLE AS y FROM road", "road"))
def exported_roads_read_back(spark, sf):
    """Feature export to JSON lines and the feature reader over what was written."""
    from regionscore.functions import geometry as G

    folder = new_path(spark, "roads")
    EX.export_features(W.roads(spark, sf).withColumnRenamed("osm_id", "source_id"), "source_id", folder)
    accepted, _ = SF.read_features(
        spark, folder, id_keys=("id", "source_id"), properties=("road_class", "name"), kinds=SF.LINES, lines=True
    )
    first = F.get(G.positions(F.col("geom")), F.lit(0))
    return accepted.select("source_id", F.nullif(F.col("road_class"), F.lit("")).alias("road_class"), first["x"].alias("x"), first["y"].alias("y"))


@query("exported_layer_checks", sql(
    "SELECT * FROM (VALUES ('regional_roads: features are well formed', 0::BIGINT), ('regional_roads: identity is present', 0), ('regional_roads: identity is unique', 0), ('regional_roads: count and hash match the manifest', 0)) t(\"check\", violations)"))
def exported_layer_checks(spark, sf):
    from regionscore.plans.publish import publish_regional_roads

    layer = publish_regional_roads(W.roads(spark, sf))
    folder = new_path(spark, "layer")
    EX.export_features(layer, "source_id", folder)
    return EX.verify_layer(EX.read_exported(spark, folder), "regional_roads", EX.build_manifest({"regional_roads": layer}))


@query("input_inventory")
def input_inventory(spark, sf):
    """Bytes and digests of the given files themselves."""
    return IN.file_digests(spark, sf).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "bytes", "sha256")


@query("cache_agreement", "SELECT 'd' || doc_id::VARCHAR AS dataset_id, doc_id % 5 <> 1 AND doc_id % 7 <> 2 AND strlen(text) <= 20000 AS agrees FROM documents")
def cache_agreement(spark, sf):
    """Documents taken as files against stored records, some of them altered."""
    d, k = W.table(spark, sf, "documents"), F.col("doc_id")
    key = F.concat(F.lit("d"), k.cast("string"))
    size, digest = F.octet_length("text").cast("bigint"), F.sha2("text", 256)
    files = d.select(
        key.alias("dataset_id"), F.lit("p").alias("target_path"), F.lit(None).cast("string").alias("url"), size.alias("bytes"), digest.alias("sha256"),
        F.lit(" ").alias("expected_sha256"), F.lit("20000").alias("max_bytes"),
    )
    records = d.where(k % 5 != 1).select(
        key.alias("dataset_id"), F.lit("p").alias("target_path"), F.lit(None).cast("string").alias("registry_url"),
        F.when(k % 7 == 2, size + 1).otherwise(size).alias("bytes"), digest.alias("sha256"),
    )
    return IN.cache_agreement(files, records)


@query("format_report", "SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'not a FeatureCollection' WHEN 2 THEN 'not valid JSON' END AS problem FROM pages")
def format_report(spark, sf):
    """Every page wrapped as a candidate file of some format."""
    k = F.col("page_id")
    quoted = F.to_json(F.struct(F.col("html").alias("type"), F.array(F.lit(1)).alias("features")))
    good = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(F.col("html")).alias("features")))
    csv = F.concat(F.lit("id,url\n"), k.cast("string"), F.lit(',"a,b"\n'))
    text = F.when(k % 4 == 0, good).when(k % 4 == 1, quoted).when(k % 4 == 2, F.col("html")).otherwise(csv)
    name = F.concat(k.cast("string"), F.when(k % 4 < 2, ".geojson").when(k % 4 == 2, ".json").otherwise(".csv"))
    files = W.table(spark, sf, "pages").select(name.alias("path"), F.lit("input").alias("dataset_id"), text.cast("binary").alias("content"))
    return IN.format_report(files).select(F.regexp_extract("path", r"^(\d+)", 1).cast("bigint").alias("page_id"), "problem")


@query("latest_observations", "SELECT c_custkey::VARCHAR AS code, max(year) AS year, arg_max(n, year) AS value FROM (SELECT o_custkey AS c_custkey, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def latest_observations(spark, sf):
    """Orders per customer and year in the shape of statistics documents."""
    per = W.table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).count()
    docs = per.groupBy(F.col("o_custkey").cast("string").alias("code")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("y").cast("string"), (F.col("y") - 1990).alias("p")))).alias("known"),
        F.map_from_entries(F.collect_list(F.struct((F.col("y") - 1990).cast("string"), F.col("count")))).alias("value"),
    )
    index = F.map_concat("known", F.create_map(F.lit("2030"), F.lit(40)))
    found = ST.latest_observation(docs.select("code", index.alias("index"), "value"))
    return found.select("code", big("year"), "value")


@query("renewable_layers", "SELECT event_type || '|' || event_id::VARCHAR AS source_id, event_type AS technology, CASE WHEN event_id % 17 <> 0 THEN value / 1000 END AS capacity_mw FROM events")
def renewable_layers(spark, sf):
    e = W.table(spark, sf, "events")
    layers = {
        kind: e.where(F.col("event_type") == kind).select(
            F.col("event_id").alias("Einheitennummer"),
            F.when(F.col("event_id") % 17 != 0, F.col("value")).otherwise(float("nan") if kind == "view" else F.lit(None)).alias("Bruttoleistung el. [kW]"),
            F.lit("In Betrieb").alias("Status"),
            F.lit(7.0).alias("lon"),
            F.lit(51.0).alias("lat"),
        )
        for kind in W.TECHNOLOGIES
    }
    return ST.union_layers(layers).select("source_id", "technology", "capacity_mw")


@query("filtered_tags", "SELECT p_partkey FROM part WHERE (p_partkey % 3 = 0 AND p_partkey % 6 IN (0, 1, 2, 3, 4)) OR (p_partkey % 3 <> 0 AND p_partkey % 6 IN (3, 4))")
def filtered_tags(spark, sf):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "way").when(k % 3 == 1, "node").otherwise("relation")
    power = F.get(F.array(*[F.lit(a) for a in (*W.ASSETS, "tower")]), (k % 6).cast("int"))
    elements = W.table(spark, sf, "part").select("p_partkey", kind.alias("type"), F.create_map(F.lit("power"), power, F.lit("name"), F.col("p_name")).alias("tags"))
    return SF.filter_tags(elements, SF.POWER_TAGS).select("p_partkey")


@query("prepared_roads", "SELECT 'a' || (o_orderkey // 4)::VARCHAR || '|' || (o_orderkey % 4)::VARCHAR || '|0|9' AS osm_id, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 10 * 100.0::DOUBLE END AS traffic_total, CASE WHEN o_orderkey % 10 NOT IN (0, 5) THEN 1::DOUBLE END AS traffic_light FROM orders")
def prepared_roads(spark, sf):
    from regionscore.functions import geometry as G

    k = F.col("o_orderkey")
    t = k % 10 * 100.0
    raw = W.table(spark, sf, "orders").select(
        F.concat(F.lit("a"), F.floor(k / 4).cast("string")).alias("ABS"), (k % 4).alias("ZSTNR"), F.lit(0).alias("VSTAT"), F.lit(9).alias("BSTAT"),
        F.lit("B").alias("STRKL"), F.lit("x").alias("STRBEZ"), F.lit("1").alias("STRNR"), F.lit("SVZ").alias("ZSTART"),
        t.alias("DTVKFZA"), t.alias("DTVKFZW"), F.when(k % 10 == 5, 0.0).otherwise(1.0).alias("DTVLVA"), F.when(k % 10 == 5, 0.0).otherwise(2.0).alias("DTVSVA"),
        G.linestring((F.lit(7.0), F.lit(51.0)), (F.lit(7.1), F.lit(51.0))).alias("geom"),
    )
    return SF.prepare_roads(raw, strict=False)[0].select("osm_id", "traffic_total", "traffic_light")


@query("prepared_energy_rows", sql(
    "SELECT year, ags, gen AS published_generation_mwh, u AS generation_components_unknown, wind_mw AS wind_capacity_mw, cap AS renewable_capacity_mw, add AS renewable_net_addition_mw FROM ("
    "SELECT coalesce(s.year, g.year) AS year, coalesce(s.ags, g.ags) AS ags, CASE WHEN s.m % 4 <> 2 THEN CASE WHEN s.m % 4 = 1 THEN 0 ELSE s.parts END END AS gen, CASE WHEN s.m IS NULL THEN 0 WHEN s.m % 4 = 2 THEN 1 ELSE 0 END AS u, "
    "CASE WHEN s.m % 4 = 1 THEN 0 ELSE s.rows END AS wind_mw, CASE WHEN s.m % 4 = 1 THEN 0 ELSE s.rows END + s.quantity AS cap, g.rows AS add FROM (SELECT * FROM panel WHERE m % 5 <> 0) s FULL JOIN (SELECT * FROM panel WHERE m % 5 <> 1) g ON s.year = g.year AND s.m = g.m)", "panel"))
def prepared_energy_rows(spark, sf):
    """Three sheets made from the panel; technologies are found by their column suffix."""
    panel, m = materialize(W.panel(spark, sf), "panel"), F.col("m")
    names = W.districts(spark, sf).select("nuts_code", F.col("district_name"))
    base = [F.col("year").alias("Jahr"), F.col("municipality_name").alias("Gemeinde"), F.col("district_name").alias("Kreis"), m.cast("string").alias("AGS")]
    named = panel.join(names, "nuts_code")
    wind = F.when(m % 4 == 1, 0.0).otherwise(F.col("rows").cast("double"))
    used = named.select(*base, F.col("quantity").alias("Stromverbrauch (GWh)"))
    stock = named.where("m % 5 <> 0").select(
        *base, wind.alias("Wind: Leistung (MW)"), F.when(~(m % 4).isin(1, 2), F.col("parts").cast("double")).alias("Wind: Stromertrag (MWh)"),
        F.col("quantity").alias("Biomasse: Leistung (MW)"), F.lit(0.0).alias("Biomasse: Stromertrag (MWh)"), F.lit(99.0).alias("Speicher: Batterie Leistung (MW)"),
    )
    growth = named.where("m % 5 <> 1").select(*base, F.col("rows").cast("double").alias("Wind: Leistung (MW)"))
    _, rows, _ = ST.prepare_energy(used, stock, growth, names)
    return rows.select(
        big("year"), "ags", "published_generation_mwh", big("generation_components_unknown").cast("int").alias("generation_components_unknown"), "wind_capacity_mw",
        "renewable_capacity_mw", "renewable_net_addition_mw",
    )


@query("layer_lineage", "SELECT 'layer' || (l % 10)::VARCHAR AS layer, 'src' || p::VARCHAR AS id, CASE WHEN p % 3 = 0 THEN 'not recorded in current successful ingest' WHEN p % 3 = 1 THEN 'recorded' ELSE 'recorded without upstream sidecar' END AS ingest_status, "
       "CASE WHEN p % 3 = 1 THEN 'up' || p::VARCHAR ELSE 'cat' || p::VARCHAR END AS source_url FROM (SELECT p_partkey AS p, p_partkey % 100 AS l FROM part)")
def layer_lineage(spark, sf):
    part, p = W.table(spark, sf, "part"), F.col("p_partkey")
    text = p.cast("string")
    source = F.concat(F.lit("src"), text)
    layers = part.select(F.concat(F.lit("layer"), (p % 100 % 10).cast("string")).alias("layer"), F.lit(0).alias("position"), source.alias("source_id"))
    catalog = part.select(source.alias("dataset_id"), F.concat(F.lit("cat"), text).alias("source_url"), F.lit("required_input").alias("source_role"), F.lit("terms").alias("licence"))
    inputs = part.where(p % 3 != 0).select(
        source.alias("source_key"), F.when(p % 3 == 1, F.concat(F.lit('{"url":"up'), text, F.lit('"}'))).alias("provenance"), F.sha2(text, 256).alias("sha256")
    )
    snapshots = part.select(source.alias("source_key"), F.lit(None).cast("date").alias("snapshot_date"), F.lit("n").alias("source_note"), F.lit(None).cast("timestamp").alias("recorded_at"))
    return PV.layer_lineage(layers, catalog, inputs, snapshots).select("layer", "id", "ingest_status", "source_url")


@query("current_run_inputs", "SELECT o_orderkey AS source_key FROM orders WHERE o_custkey = (SELECT o_custkey FROM (SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY 1) ORDER BY latest DESC, lpad(o_custkey::VARCHAR, 12, '0') DESC LIMIT 1)")
def current_run_inputs(spark, sf):
    """Customers as runs, their orders as inputs: only the latest run's inputs count."""
    o = W.table(spark, sf, "orders")
    run = F.lpad(F.col("o_custkey").cast("string"), 12, "0")
    runs = o.groupBy(run.alias("ingest_run_id")).agg(F.max("o_orderdate").alias("recorded_at"))
    inputs = o.select(run.alias("ingest_run_id"), F.col("o_orderkey").alias("source_key"))
    return PV.current_inputs(runs, inputs).select("source_key")


@query("source_dates_replaced", "SELECT 's' || c_custkey::VARCHAR AS source_key, CASE WHEN c_custkey = 7 THEN DATE '2026-04-22' ELSE DATE '2020-01-01' END AS snapshot_date FROM customer")
def source_dates_replaced(spark, sf):
    old = W.table(spark, sf, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("source_key"), F.to_date(F.lit("2020-01-01")).alias("snapshot_date"))
    new = old.where("source_key = 's7'").withColumn("snapshot_date", F.to_date(F.lit("2026-04-22")))
    return PV.set_source_date(old, "s7", new)


@query("selected_sources", "SELECT c_custkey::VARCHAR AS dataset_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_custkey % 2 = 0")
def selected_sources(spark, sf):
    c = W.table(spark, sf, "customer")
    access = F.when(F.col("c_mktsegment") == "BUILDING", "public").when(F.col("c_mktsegment") == "HOUSEHOLD", "public_large").otherwise("manual_later")
    catalog = c.select(F.col("c_custkey").cast("string").alias("dataset_id"), access.alias("access_type"))
    ids = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("dataset_id"))
    return ST.select_sources(catalog, ids=ids, include_large=True)[0].select("dataset_id")


@query("finite_share_of_values", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def finite_share_of_values(spark, sf):
    from regionscore.functions.parsing import finite_or_null

    e = W.table(spark, sf, "events").withColumn("v", finite_or_null(F.col("value")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), r(F.avg("v"), 6).alias("mean"))
