"""Roll-ups, measurements, scores, scenario and published layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import world as W
from queries.registry import big, query, r, score
from queries.world import CTES, INSIDE, normalized, sql
from regionscore.functions import geometry as G
from regionscore.operators import mapdata as MD
from regionscore.operators import rollups as RU
from regionscore.operators import spatial as SP
from regionscore.operators.quantiles import bounds, exact_percentiles, rank_desc_nulls_last
from queries.model import SCORE_MODEL, sql_values
from regionscore.operators.scoring import evaluate_model, score_model
from regionscore.plans import energy as E
from regionscore.plans import measures as M
from regionscore.plans import publish as P
from regionscore.plans import scenario as SC
from regionscore.plans import scores as S
from regionscore.plans import verify as V
from regionscore.schemas import SOURCE_SNAPSHOTS
from regionscore.storage import materialize

COUNTS = M.STATION_COUNTS
_ROLL = (
    "count(*) AS chargers_total, sum(coalesce(charging_points, 1))::BIGINT AS charging_points_total, "
    "count(*) FILTER (WHERE max_point_power_kw >= 50) AS fast_chargers_total, count(*) FILTER (WHERE max_point_power_kw < 50) AS normal_chargers_total, "
    "count(*) FILTER (WHERE max_point_power_kw IS NULL) AS unknown_power_chargers_total"
)

# Measurements and scores restated in SQL on top of the world's CTEs.
CTES["roll"] = (("owner",), f"roll AS (SELECT nuts_code, {_ROLL} FROM owner GROUP BY nuts_code)")
CTES["met"] = (("d", "dm", "roll", "near_st", "pop"), "met AS (SELECT d.n, d.nuts_code, d.ags, d.district_name, area_km2, population, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTS)
    + ", distance_m AS distance_to_nearest_charger_m FROM d JOIN dm USING (nuts_code) LEFT JOIN pop ON pop.n = d.n LEFT JOIN roll USING (nuts_code) LEFT JOIN near_st USING (nuts_code))")
CTES["tr"] = (("rclip", "d", "dm", "near_road"), """tr0 AS (SELECT n, sum(km) AS km, sum(km) FILTER (WHERE weight IS NOT NULL) AS known, sum(km * weight) AS wkm FROM rclip GROUP BY n),
tr AS (SELECT d.nuts_code, coalesce(km, 0) AS traffic_road_length_km, coalesce(known, 0) AS traffic_measured_length_km, known / nullif(km, 0) AS traffic_length_coverage,
  wkm / nullif(known, 0) AS traffic_intensity_dtv, wkm / nullif(area_km2, 0) AS traffic_weighted_road_density, distance_m AS distance_to_nearest_road_m
  FROM d JOIN dm USING (nuts_code) LEFT JOIN tr0 ON tr0.n = d.n LEFT JOIN near_road USING (nuts_code))""")
CTES["gr"] = (("lclip", "d", "dm", "sub", "near_sub"), f"""gl AS (SELECT n, sum(km) AS km, sum(km) FILTER (WHERE weight IS NOT NULL) AS known, sum(km * weight) AS wkm, count(*) AS segments, count(weight) / count(*)::DOUBLE AS cov FROM lclip GROUP BY n),
gs AS (SELECT nuts_code, count(*) AS c, max(kv) AS mx, count(kv) / count(*)::DOUBLE AS cov FROM sub JOIN d ON {INSIDE} GROUP BY nuts_code),
gr AS (SELECT d.nuts_code, coalesce(gl.km, 0) AS grid_line_length_km, coalesce(known, 0) AS grid_line_length_km_known_voltage, coalesce(segments, 0) AS grid_line_segments, coalesce(gs.c, 0) AS substation_count,
  mx AS maximum_mapped_voltage_kv, gl.cov AS line_voltage_coverage, gs.cov AS substation_voltage_coverage, wkm / nullif(area_km2, 0) AS voltage_weighted_line_density,
  coalesce(gs.c, 0) / nullif(area_km2, 0) AS substation_density, distance_m AS distance_to_nearest_substation_m
  FROM d JOIN dm USING (nuts_code) LEFT JOIN gl ON gl.n = d.n LEFT JOIN gs ON gs.nuts_code = d.nuts_code LEFT JOIN near_sub ON near_sub.nuts_code = d.nuts_code)""")
CTES["rr"] = (("re", "d", "dm"), f"""rr0 AS (SELECT nuts_code, count(*) AS c, sum(capacity_mw) AS mw, count(DISTINCT technology) FILTER (WHERE capacity_mw > 0) AS t FROM re JOIN d ON {INSIDE} WHERE status = 'In Betrieb' GROUP BY nuts_code),
rr AS (SELECT dm.nuts_code, coalesce(c, 0) AS renewable_installation_count, coalesce(mw, 0) AS renewable_capacity_mw, coalesce(t, 0) AS renewable_technology_count, coalesce(mw, 0) / nullif(area_km2, 0) AS renewable_capacity_mw_per_km2 FROM dm LEFT JOIN rr0 USING (nuts_code))""")


def _scored(raw: str, name: str, indicator: str) -> str:
    """CTEs scoring an indicator from its measures: bounds, rounded parts, rounded composite."""
    terms = [t for t in SCORE_MODEL if t.indicator_score == indicator and t.measure]
    lows = ", ".join(f"quantile_cont({t.measure}, 0.05) AS l{i}, quantile_cont({t.measure}, 0.95) AS h{i}" for i, t in enumerate(terms))
    parts = ", ".join(f"{normalized(t.measure, f'l{i}', f'h{i}', bool(t.inverse))} AS {t.component_score}" for i, t in enumerate(terms))
    whole = _composite(indicator)
    first = f"{name}_b AS (SELECT {lows} FROM {raw}),\n{name}_p AS (SELECT {raw}.*, {parts} FROM {raw}, {name}_b)"
    extra = [t for t in SCORE_MODEL if t.indicator_score == indicator and not t.measure]
    return first if extra else f"{first},\n{name} AS (SELECT *, {whole} AS {indicator} FROM {name}_p)"


def _composite(indicator: str) -> str:
    terms = [t for t in SCORE_MODEL if t.indicator_score == indicator]
    return "round(" + " + ".join(f"{t.constant}::DECIMAL(5, 2) + {t.weight}::DECIMAL(4, 2) * {t.component_score}::DECIMAL(5, 1)" for t in terms) + ", 1)::DECIMAL(5, 1)"


CTES["tm"] = (("tr",), _scored("tr", "tm", "transport_load_score"))
CTES["gm"] = (("gr",), _scored("gr", "gm", "grid_readiness_proxy_score"))
CTES["rm"] = (("rr",), _scored("rr", "rm", "renewable_context_score"))
CTES["yr"] = (("con", "bal"), "yr AS (SELECT max(year) AS y FROM con WHERE year IN (SELECT year FROM bal WHERE gen IS NOT NULL AND wind IS NOT NULL))")
CTES["uni"] = (("con", "bal"), "uni AS (SELECT nuts_code, count(DISTINCT ags) AS expected FROM (SELECT nuts_code, ags FROM con UNION SELECT nuts_code, ags FROM bal) GROUP BY nuts_code)")
CTES["cr"] = (("con", "yr"), "cr AS (SELECT nuts_code, count(gwh) AS reported, sum(gwh) * 1000.0::DOUBLE AS mwh FROM con, yr WHERE year = y GROUP BY nuts_code)")
CTES["sr"] = (("bal", "yr"), "sr AS (SELECT nuts_code, count(*) FILTER (WHERE gen IS NOT NULL AND wind IS NOT NULL) AS reported, count(cap) AS cap_reported, sum(gen) AS gen, sum(wind) AS wind, sum(cap) AS cap, sum(unknown) AS unknown FROM bal, yr WHERE year = y GROUP BY nuts_code)")
CTES["grow"] = (("bal", "yr", "uni"), """gy AS (SELECT nuts_code, year, count(addition) AS reported, sum(addition) AS total FROM bal, yr WHERE year BETWEEN y - 2 AND y GROUP BY nuts_code, year),
grow AS (SELECT nuts_code, count(*) FILTER (WHERE reported = expected) AS years, sum(total) AS total FROM gy JOIN uni USING (nuts_code) GROUP BY nuts_code)""")
CTES["er"] = (("d", "dm", "uni", "cr", "sr", "grow", "yr"), """er0 AS (SELECT d.nuts_code, y AS reporting_year, area_km2, expected AS expected_municipalities, coalesce(cr.reported, 0) AS consumption_municipalities_reported, coalesce(sr.reported, 0) AS renewable_municipalities_reported,
  coalesce(cap_reported, 0) AS renewable_capacity_municipalities_reported, coalesce(years, 0) AS growth_years_reported, coalesce(unknown, 0)::BIGINT AS generation_components_unknown,
  CASE WHEN cr.reported = expected THEN mwh END AS consumption_mwh, CASE WHEN sr.reported = expected THEN gen END AS published_generation_mwh, CASE WHEN sr.reported = expected THEN wind END AS wind_capacity_mw,
  CASE WHEN cap_reported = expected THEN cap END AS renewable_capacity_mw, CASE WHEN years = 3 THEN grow.total END AS renewable_net_addition_3y_mw
  FROM d JOIN dm USING (nuts_code) CROSS JOIN yr LEFT JOIN uni USING (nuts_code) LEFT JOIN cr USING (nuts_code) LEFT JOIN sr USING (nuts_code) LEFT JOIN grow USING (nuts_code)),
er AS (SELECT *, wind_capacity_mw * 2000 AS estimated_wind_generation_mwh, published_generation_mwh + wind_capacity_mw * 2000 AS total_renewable_generation_mwh,
  renewable_net_addition_3y_mw / nullif(area_km2, 0) AS renewable_growth_density_mw_per_km2, CASE WHEN consumption_mwh > 0 THEN (published_generation_mwh + wind_capacity_mw * 2000) / consumption_mwh END AS renewable_balance_ratio FROM er0)""")
CTES["em"] = (("er", "gm"), _scored("er", "em", "grid_absorption_risk_proxy_score") + f""",
em0 AS (SELECT em_p.*, gm.grid_readiness_proxy_score FROM em_p LEFT JOIN gm USING (nuts_code)),
em AS (SELECT *, {_composite("grid_absorption_risk_proxy_score")} AS grid_absorption_risk_proxy_score,
  CASE WHEN local_energy_balance_score IS NULL OR renewable_growth_score IS NULL OR grid_readiness_proxy_score IS NULL THEN 'missing_required_input' WHEN wind_capacity_mw > 0 THEN 'hybrid_complete' ELSE 'published_complete_no_wind' END AS energy_data_quality_flag,
  CASE WHEN expected_municipalities IS NULL THEN 'no_municipal_energy_data' WHEN consumption_mwh IS NULL THEN 'incomplete_consumption_coverage' WHEN consumption_mwh <= 0 THEN 'zero_consumption_denominator'
    WHEN published_generation_mwh IS NULL OR wind_capacity_mw IS NULL THEN 'incomplete_renewable_coverage' WHEN renewable_net_addition_3y_mw IS NULL THEN 'incomplete_growth_window' WHEN grid_readiness_proxy_score IS NULL THEN 'unavailable_grid_readiness_proxy' END AS energy_unavailable_reason,
  CASE WHEN expected_municipalities IS NULL THEN 'no_municipal_energy_data' WHEN renewable_capacity_mw IS NULL THEN 'incomplete_capacity_coverage' END AS renewable_capacity_unavailable_reason FROM em0)""")
CTES["io"] = (("met", "tm", "gm", "rm"), f"""io0 AS (SELECT met.nuts_code, transport_load_score, grid_readiness_proxy_score, renewable_context_score FROM met LEFT JOIN tm USING (nuts_code) LEFT JOIN gm USING (nuts_code) LEFT JOIN rm USING (nuts_code)),
io AS (SELECT *, {_composite("infrastructure_opportunity_score")} AS infrastructure_opportunity_score FROM io0)""")


def _ev(source: str, name: str, bound_source: str) -> str:
    terms = [t for t in SCORE_MODEL if t.indicator_score == "ev_readiness_score"]
    lows = ", ".join(f"quantile_cont({t.measure}, 0.05) AS l{i}, quantile_cont({t.measure}, 0.95) AS h{i}" for i, t in enumerate(terms))
    parts = ", ".join(f"{normalized(t.measure, f'l{i}', f'h{i}', bool(t.inverse))} AS {t.component_score}" for i, t in enumerate(terms))
    measures = "charging_points_total / nullif(area_km2, 0) AS charging_points_per_km2, chargers_total / nullif(area_km2, 0) AS chargers_per_km2, charging_points_total * 100000.0::DOUBLE / nullif(population, 0) AS charging_points_per_100k_population"
    return f"""{name}_r AS (SELECT *, {measures} FROM {source}),
{name}_b AS (SELECT {lows} FROM {bound_source}),
{name}_p AS (SELECT {name}_r.*, {parts} FROM {name}_r, {name}_b),
{name}_q AS (SELECT *, {_composite("ev_readiness_score")} AS ev_readiness_score FROM {name}_p),
{name}_s AS (SELECT {name}_q.*, infrastructure_opportunity_score, {_composite("charger_deficit_score")} AS charger_deficit_score FROM {name}_q LEFT JOIN io USING (nuts_code)),
{name}_t AS (SELECT *, {_composite("investment_priority_score")} AS investment_priority_score FROM {name}_s),
{name} AS (SELECT *, rank() OVER (ORDER BY investment_priority_score DESC NULLS LAST) AS priority_rank FROM {name}_t)"""


CTES["ev"] = (("met", "io"), _ev("met", "ev", "ev_r"))
_OK = ("charging_points BETWEEN 1 AND 100 AND power_kw BETWEEN 1 AND 1000 AND max_point_power_kw > 0 AND max_point_power_kw <= power_kw AND trim(name) <> ''")
CTES["pok"] = (("prop", "d"), f"pok AS (SELECT prop.*, x.nuts_code FROM prop JOIN (SELECT id, min(nuts_code) AS nuts_code FROM prop JOIN d ON {INSIDE} GROUP BY id HAVING count(*) = 1) x USING (id) WHERE {_OK}),\n"
    "pone AS (SELECT * FROM pok QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) = 1)")
CTES["scen"] = (("st", "pok", "dm", "d", "met", "ev", "io"), f"""eff AS (SELECT 'o' || source_id AS source_id, charging_points, max_point_power_kw, lon, lat FROM st UNION ALL SELECT 'p' || id, charging_points, max_point_power_kw, lon, lat FROM pone),
{W.sql_utm("eff", "eff_m", [("lon", "lat", "x", "y")])},
eff_o AS (SELECT source_id, any_value(charging_points) AS charging_points, any_value(max_point_power_kw) AS max_point_power_kw, min(nuts_code) AS nuts_code FROM eff JOIN d ON {INSIDE} GROUP BY source_id),
sc_roll AS (SELECT nuts_code, {_ROLL} FROM eff_o GROUP BY nuts_code),
sc_near AS (SELECT nuts_code, min(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS m FROM dm, eff_m GROUP BY nuts_code),
sc_met AS (SELECT met.nuts_code, met.area_km2, met.population, {", ".join(f"coalesce(sc_roll.{c}, 0) AS {c}" for c in COUNTS)}, m AS distance_to_nearest_charger_m FROM met LEFT JOIN sc_roll USING (nuts_code) LEFT JOIN sc_near USING (nuts_code)),
{_ev("sc_met", "scen", "ev_r")}""")


def _index(spark, sf):
    return W.prepared(spark, sf).index


@query("station_rollup", sql("SELECT * FROM roll", "roll"))
def station_rollup(spark, sf):
    return RU.station_rollup(M.station_owners(W.stations(spark, sf), W.prepared(spark, sf)))


@query("substation_rollup", sql(
    f"SELECT nuts_code, count(*) AS substation_count, max(kv) AS maximum_mapped_voltage_kv, round(count(kv) / count(*)::DOUBLE, 9) AS substation_voltage_coverage FROM sub JOIN d ON {INSIDE} GROUP BY nuts_code", "sub", "d"))
def substation_rollup(spark, sf):
    from regionscore.functions.parsing import voltage_kv

    subs = W.grid(spark, sf).where(F.col("asset_type").isin("substation", "transformer")).withColumn("voltage_kv", voltage_kv(F.col("voltage")))
    rolled = RU.substation_rollup(SP.intersect_pairs(subs, "source_id", _index(spark, sf), keep=["voltage_kv"]))
    return rolled.withColumn("substation_voltage_coverage", r("substation_voltage_coverage", 9))


@query("road_length_rollup", sql(
    """SELECT nuts_code, round(sum(km), 5) AS length_km, round(sum(km) FILTER (WHERE weight IS NOT NULL), 5) AS known_length_km, round(sum(km) FILTER (WHERE weight IS NOT NULL) / nullif(sum(km), 0), 8) AS length_coverage,
    round(sum(km * weight), 2) AS weighted_km, round(sum(km * weight) / nullif(sum(km) FILTER (WHERE weight IS NOT NULL), 0), 5) AS weighted_mean, count(*) AS parts, round(count(weight) / count(*)::DOUBLE, 9) AS part_coverage FROM rclip JOIN d USING (n) GROUP BY nuts_code""", "rclip", "d"))
def road_length_rollup(spark, sf):
    d = W.prepared(spark, sf)
    parts = SP.clip_lengths(W.roads(spark, sf), d.table, line_id="osm_id", keep=["traffic_total"], index=d.index, metric_index=d.metric_index)
    return RU.weighted_length_rollup(parts, "traffic_total").select(
        "nuts_code", r("length_km", 5), r("known_length_km", 5), r("length_coverage", 8), r("weighted_km", 2), r("weighted_mean", 5), "parts", r("part_coverage", 9)
    )


@query("renewable_rollup", sql(
    f"SELECT nuts_code, count(*) AS renewable_installation_count, round(sum(capacity_mw), 6) AS renewable_capacity_mw, count(DISTINCT technology) FILTER (WHERE capacity_mw > 0) AS renewable_technology_count FROM re JOIN d ON {INSIDE} GROUP BY nuts_code", "re", "d"))
def renewable_rollup(spark, sf):
    hits = SP.assign_regions(W.renewables(spark, sf), point_id="source_id", ambiguous="all", index=_index(spark, sf))
    return RU.renewable_rollup(hits).select("nuts_code", "renewable_installation_count", r("renewable_capacity_mw"), "renewable_technology_count")


@query("reporting_year", sql("SELECT y AS reporting_year FROM yr", "yr"))
def reporting_year(spark, sf):
    return RU.reporting_year(W.consumption(spark, sf), W.balance(spark, sf)).select(big("reporting_year"))


@query("municipal_universe", sql("SELECT nuts_code, expected AS expected_municipalities FROM uni", "uni"))
def municipal_universe(spark, sf):
    return RU.municipal_universe(W.consumption(spark, sf), W.balance(spark, sf))


@query("consumption_of_a_year", sql("SELECT nuts_code, count(gwh) AS reported, sum(gwh) AS gwh FROM con WHERE year = 1999 GROUP BY nuts_code", "con"))
def consumption_of_a_year(spark, sf):
    return RU.panel_rollup(
        W.consumption(spark, sf), F.lit(1999), {"gwh": F.col("consumption_gwh")}, {"reported": F.col("consumption_gwh").isNotNull()}
    )


@query("growth_window", sql("SELECT nuts_code, years AS growth_years_reported, total AS net_addition_reported FROM grow", "grow"))
def growth_window(spark, sf):
    panel = W.balance(spark, sf)
    year = RU.reporting_year(W.consumption(spark, sf), panel).scalar()
    universe = RU.municipal_universe(W.consumption(spark, sf), panel)
    return RU.complete_window(panel, universe, year, 3, "renewable_net_addition_mw")


@query("order_price_bounds", sql(
    "SELECT round(quantile_cont(o_totalprice, 0.05), 6) AS o_totalprice_low, round(quantile_cont(o_totalprice, 0.95), 6) AS o_totalprice_high FROM orders"))
def order_price_bounds(spark, sf):
    b = bounds(W.table(spark, sf, "orders"), ["o_totalprice"])
    return b.select(r("o_totalprice_low"), r("o_totalprice_high"))


@query("lineitem_percentiles", sql(
    "SELECT m AS metric, f AS fraction, round(CASE m WHEN 'l_extendedprice' THEN CASE f WHEN 0.05 THEN a1 WHEN 0.5 THEN a2 ELSE a3 END ELSE CASE f WHEN 0.05 THEN b1 WHEN 0.5 THEN b2 ELSE b3 END END, 6) AS value "
    "FROM (SELECT quantile_cont(l_extendedprice, 0.05) AS a1, quantile_cont(l_extendedprice, 0.5) AS a2, quantile_cont(l_extendedprice, 0.95) AS a3, quantile_cont(l_quantity, 0.05) AS b1, quantile_cont(l_quantity, 0.5) AS b2, quantile_cont(l_quantity, 0.95) AS b3 FROM lineitem), "
    "(VALUES ('l_extendedprice'), ('l_quantity')) t(m), (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) u(f)"))
def lineitem_percentiles(spark, sf):
    found = exact_percentiles(W.table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], [0.05, 0.5, 0.95])
    return found.select("metric", "fraction", r("value"))


@query("order_price_rank", sql(
    "SELECT o_orderkey, rank() OVER (ORDER BY s DESC NULLS LAST) AS price_rank FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 3 THEN round(o_totalprice, -2) END AS s FROM orders)"))
def order_price_rank(spark, sf):
    t = W.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 10 != 3, F.round("o_totalprice", -2)).alias("s")
    )
    return rank_desc_nulls_last(t, "s", "price_rank").select("o_orderkey", "price_rank")


_MET = ["nuts_code", "ags", "district_name", "population", *COUNTS]


@query("district_metrics", sql(
    f"SELECT {', '.join(_MET)}, round(area_km2, 6) AS area_km2, round(distance_to_nearest_charger_m, 3) AS distance_to_nearest_charger_m FROM met", "met"))
def district_metrics(spark, sf):
    m = M.district_metrics(W.prepared(spark, sf), W.stations(spark, sf), W.population(spark, sf))
    return m.select(*[big(c) if c == "population" else F.col(c) for c in _MET], r("area_km2"), r("distance_to_nearest_charger_m", 3))


_T_SCORES = ("traffic_intensity_score", "traffic_road_density_score", "road_proximity_score", "transport_load_score")
_T_VALUES = {"traffic_road_length_km": 5, "traffic_measured_length_km": 5, "traffic_length_coverage": 8, "traffic_intensity_dtv": 4, "traffic_weighted_road_density": 5, "distance_to_nearest_road_m": 3}


def _select(values: dict[str, int], scores, *plain: str) -> str:
    return ", ".join([*plain, *[f"round({c}, {n}) AS {c}" for c, n in values.items()], *[f"{s}::DOUBLE AS {s}" for s in scores]])


@query("transport_metrics", sql(
    f"SELECT {_select(_T_VALUES, _T_SCORES, 'nuts_code')}, CASE WHEN traffic_road_length_km = 0 THEN 'no_counted_road_network' WHEN traffic_measured_length_km = 0 THEN 'no_published_traffic_value' WHEN traffic_length_coverage < 1 THEN 'partial_traffic_coverage' ELSE 'complete_traffic_coverage' END AS transport_data_quality_flag FROM tm", "tm"))
def transport_metrics(spark, sf):
    t = W.analytics(spark, sf)["transport"]
    return t.select("nuts_code", *[r(c, n) for c, n in _T_VALUES.items()], *[score(s) for s in _T_SCORES], "transport_data_quality_flag")


_G_SCORES = ("substation_proximity_score", "voltage_line_density_score", "substation_density_score", "grid_readiness_proxy_score")
_G_VALUES = {"grid_line_length_km": 5, "grid_line_length_km_known_voltage": 5, "maximum_mapped_voltage_kv": 6, "line_voltage_coverage": 8, "substation_voltage_coverage": 8, "voltage_weighted_line_density": 6, "substation_density": 8, "distance_to_nearest_substation_m": 3}


@query("grid_metrics", sql(
    f"SELECT {_select(_G_VALUES, _G_SCORES, 'nuts_code', 'grid_line_segments', 'substation_count')}, CASE WHEN distance_to_nearest_substation_m IS NULL THEN 'no_mapped_substation' WHEN grid_line_segments = 0 THEN 'no_mapped_grid_lines' WHEN coalesce(line_voltage_coverage, 0) = 0 THEN 'unknown_line_voltage' WHEN line_voltage_coverage < 1 THEN 'partial_line_voltage' ELSE 'complete_grid_inputs' END AS grid_data_quality_flag FROM gm", "gm"))
def grid_metrics(spark, sf):
    g = W.analytics(spark, sf)["grid"]
    return g.select("nuts_code", big("grid_line_segments"), big("substation_count"), *[r(c, n) for c, n in _G_VALUES.items()], *[score(s) for s in _G_SCORES], "grid_data_quality_flag")


_R_SCORES = ("renewable_capacity_density_score", "renewable_technology_diversity_score", "renewable_context_score")
_R_VALUES = {"renewable_capacity_mw": 6, "renewable_capacity_mw_per_km2": 8}


@query("renewable_metrics", sql(
    f"SELECT {_select(_R_VALUES, _R_SCORES, 'nuts_code', 'renewable_installation_count', 'renewable_technology_count')} FROM rm", "rm"))
def renewable_metrics(spark, sf):
    t = W.analytics(spark, sf)["renewable"]
    return t.select("nuts_code", "renewable_installation_count", "renewable_technology_count", *[r(c, n) for c, n in _R_VALUES.items()], *[score(s) for s in _R_SCORES])


_E_PLAIN = ("nuts_code", "reporting_year", "expected_municipalities", "consumption_municipalities_reported", "renewable_municipalities_reported",
            "renewable_capacity_municipalities_reported", "growth_years_reported", "generation_components_unknown")
_E_VALUES = {"consumption_mwh": 3, "published_generation_mwh": 3, "estimated_wind_generation_mwh": 3, "total_renewable_generation_mwh": 3, "renewable_capacity_mw": 5,
             "renewable_net_addition_3y_mw": 5, "renewable_growth_density_mw_per_km2": 9, "renewable_balance_ratio": 9}
_E_SCORES = ("local_energy_balance_score", "renewable_growth_score", "grid_readiness_proxy_score", "grid_absorption_risk_proxy_score")
_E_TEXT = ("energy_data_quality_flag", "energy_unavailable_reason", "renewable_capacity_unavailable_reason")


@query("energy_balance_raw", sql(f"SELECT {_select(_E_VALUES, (), *_E_PLAIN)} FROM er", "er"))
def energy_balance_raw(spark, sf):
    raw = E.energy_balance_raw(
        W.districts(spark, sf).join(W.prepared(spark, sf).measures, "nuts_code"), W.consumption(spark, sf), W.balance(spark, sf)
    )
    return raw.select(*[F.col(c) if c == "nuts_code" else big(c) for c in _E_PLAIN], *[r(c, n) for c, n in _E_VALUES.items()])


@query("local_energy_balance", sql(f"SELECT {_select({}, _E_SCORES, 'nuts_code', *_E_TEXT)}, round(consumption_municipalities_reported / nullif(expected_municipalities, 0), 9) AS consumption_municipal_coverage FROM em", "em"))
def local_energy_balance(spark, sf):
    return W.analytics(spark, sf)["energy"].select(
        "nuts_code", *_E_TEXT, *[score(s) for s in _E_SCORES], r("consumption_municipal_coverage", 9)
    )


@query("infrastructure_opportunity", sql(
    "SELECT nuts_code, infrastructure_opportunity_score::DOUBLE AS infrastructure_opportunity_score, CASE WHEN transport_load_score IS NULL OR grid_readiness_proxy_score IS NULL OR renewable_context_score IS NULL THEN 'missing_required_component' ELSE 'complete_proxy_inputs' END AS infrastructure_data_quality_flag FROM io", "io"))
def infrastructure_opportunity(spark, sf):
    return W.analytics(spark, sf)["opportunity"].select("nuts_code", score("infrastructure_opportunity_score"), "infrastructure_data_quality_flag")


_EV_SCORES = ("charger_density_score", "charger_accessibility_score", "population_adjusted_coverage_score", "ev_readiness_score", "charger_deficit_score", "investment_priority_score")
_EV_VALUES = {"charging_points_per_km2": 8, "chargers_per_km2": 8, "charging_points_per_100k_population": 6}


@query("ev_baseline", sql(f"SELECT {_select(_EV_VALUES, _EV_SCORES, 'nuts_code', 'priority_rank')} FROM ev", "ev"))
def ev_baseline(spark, sf):
    return W.analytics(spark, sf)["baseline"].select("nuts_code", "priority_rank", *[r(c, n) for c, n in _EV_VALUES.items()], *[score(s) for s in _EV_SCORES])


@query("canonical_district_row", sql(
    "SELECT ev.nuts_code, ev.charger_deficit_score::DOUBLE AS charger_deficit_score, tm.transport_load_score::DOUBLE AS transport_load_score, gm.substation_count, rm.renewable_technology_count, round(rm.renewable_capacity_mw, 6) AS operating_asset_renewable_capacity_mw, "
    "round(em.renewable_capacity_mw, 5) AS municipal_workbook_renewable_capacity_mw, em.reporting_year AS energy_reporting_year, em.energy_unavailable_reason, 'nrw-2026.09.1' AS formula_version, 'charger_snapshot_date_not_recorded' AS charger_snapshot_unavailable_reason "
    "FROM ev JOIN tm USING (nuts_code) JOIN gm USING (nuts_code) JOIN rm USING (nuts_code) JOIN em USING (nuts_code)", "ev", "tm", "gm", "rm", "em"))
def canonical_district_row(spark, sf):
    return W.analytics(spark, sf)["baseline"].select(
        "nuts_code", score("charger_deficit_score"), score("transport_load_score"), big("substation_count"), "renewable_technology_count",
        r("operating_asset_renewable_capacity_mw"), r("municipal_workbook_renewable_capacity_mw", 5), big("energy_reporting_year"),
        "energy_unavailable_reason", "formula_version", "charger_snapshot_unavailable_reason",
    )


def _proposed(spark, sf):
    """Accepted proposals, the earliest valid one per request."""
    accepted, _ = SC.validate_proposals(W.proposals(spark, sf), _index(spark, sf))
    first = accepted.groupBy("request_id").agg(F.min(F.struct("created_at", "id")).alias("f")).select("request_id", F.col("f.id").alias("id"))
    return materialize(accepted.join(first, ["request_id", "id"], "left_semi"), "proposed")


def _compared(spark, sf, full: bool = False):
    a = W.analytics(spark, sf)
    proposed = _proposed(spark, sf)
    if full:
        measures = SC.scenario_measures_full(a.districts, a["district_metrics"], a.inputs.stations, proposed)
    else:
        measures = SC.scenario_measures(a.districts, a["district_metrics"], proposed)
    return SC.scenario_compare(materialize(measures, "scenario"), a["baseline"], a["ev_bounds"], a["opportunity"])


_C_COUNTS = ("chargers_total", "charging_points_total", "unknown_power_chargers_total")
_C_SCORES = ("charger_density_score", "charger_accessibility_score", "ev_readiness_score", "investment_priority_score")
_SCENARIO_SQL = sql(
    "SELECT b.nuts_code, " + ", ".join(f"b.{c} AS baseline_{c}, s.{c} AS scenario_{c}, s.{c} - b.{c} AS {c}_delta" for c in _C_COUNTS) + ", "
    + ", ".join(f"b.{c}::DOUBLE AS baseline_{c}, s.{c}::DOUBLE AS scenario_{c}, (s.{c} - b.{c})::DOUBLE AS {c}_delta" for c in _C_SCORES)
    + ", round(s.distance_to_nearest_charger_m, 3) AS scenario_distance_to_nearest_charger_m, b.priority_rank AS baseline_priority_rank, s.priority_rank AS scenario_priority_rank FROM ev b JOIN scen s USING (nuts_code)",
    "ev", "scen")


def _compared_columns(df):
    names = [f(c) for c in (*_C_COUNTS, *_C_SCORES) for f in ("baseline_{}".format, "scenario_{}".format, "{}_delta".format)]
    typed = [big(n) if any(c in n for c in _C_COUNTS) else score(n) for n in names]
    return df.select("nuts_code", *typed, r("scenario_distance_to_nearest_charger_m", 3), "baseline_priority_rank", "scenario_priority_rank")


@query("scenario_comparison", _SCENARIO_SQL)
def scenario_comparison(spark, sf):
    return _compared_columns(_compared(spark, sf))


@query("scenario_comparison_recomputed", _SCENARIO_SQL)
def scenario_comparison_recomputed(spark, sf):
    return _compared_columns(_compared(spark, sf, full=True))


@query("scenario_change_view", sql(
    "SELECT b.nuts_code, s.chargers_total - b.chargers_total AS chargers_total, (s.ev_readiness_score - b.ev_readiness_score)::DOUBLE AS ev_readiness_score, CASE WHEN b.infrastructure_opportunity_score IS NOT NULL THEN 0::DOUBLE END AS infrastructure_opportunity_score, s.priority_rank AS priority_rank, 'change' AS scenario_view_mode FROM ev b JOIN scen s USING (nuts_code)", "ev", "scen"))
def scenario_change_view(spark, sf):
    v = SC.project_view(_compared(spark, sf), "change")
    return v.select("nuts_code", big("chargers_total"), score("ev_readiness_score"), score("infrastructure_opportunity_score"), "priority_rank", "scenario_view_mode")


@query("scenario_coverage_issue", sql(
    "SELECT format('scenario metrics do not cover the canonical baseline districts ({} missing, {} unexpected)', count(*) FILTER (WHERE n NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000)), (SELECT count(DISTINCT s_suppkey) FROM supplier WHERE s_suppkey >= 25 AND s_acctbal > 9000)) AS issue FROM d", "d"))
def scenario_coverage_issue(spark, sf):
    supplier = W.table(spark, sf, "supplier")
    code = lambda c: F.format_string("DEA%02d", F.col(c).cast("bigint"))
    some = supplier.where("s_acctbal > 3000").select(code("s_nationkey").alias("nuts_code")).distinct()
    strange = supplier.where("s_suppkey >= 25 and s_acctbal > 9000").select(code("s_suppkey").alias("nuts_code"))
    return SC.coverage_issue(some.unionByName(strange), W.districts(spark, sf))


@query("score_model", sql(
    "SELECT 'EV Readiness' AS indicator, m AS measure, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound FROM (SELECT unnest(['charging_points_per_km2', 'distance_to_nearest_charger_m', 'charging_points_per_100k_population']) AS m, unnest([l0, l1, l2]) AS lo, unnest([h0, h1, h2]) AS hi FROM ev_b) "
    "UNION ALL SELECT 'Transport Load', m, round(lo, 6), round(hi, 6) FROM (SELECT unnest(['traffic_intensity_dtv', 'traffic_weighted_road_density', 'distance_to_nearest_road_m']) AS m, unnest([l0, l1, l2]) AS lo, unnest([h0, h1, h2]) AS hi FROM tm_b)", "ev", "tm"))
def score_model_bounds(spark, sf):
    m = W.analytics(spark, sf)["score_model"]
    return m.where(F.col("indicator").isin("EV Readiness", "Transport Load")).select("indicator", "measure", r("lower_bound"), r("upper_bound"))


@query("score_model_terms", f"SELECT *, (SELECT count(*) FROM orders) AS orders FROM {sql_values()}")
def score_model_terms(spark, sf):
    """Every term of the published model with its weight, constant, measure, unit and direction."""
    model = score_model(spark).drop("formula_version", "lower_bound", "upper_bound")
    known = W.table(spark, sf, "orders").agg(F.count("*").alias("orders"))
    return model.withColumns({c: F.col(c).cast("double") for c in ("component_weight", "constant_term")}).join(F.broadcast(known))


@query("model_evaluation", sql(
    "SELECT nuts_code, 'ev_readiness_score' AS indicator_score, ev_readiness_score::DOUBLE AS expected_score FROM ev UNION ALL SELECT nuts_code, 'charger_deficit_score', charger_deficit_score::DOUBLE FROM ev UNION ALL SELECT nuts_code, 'investment_priority_score', investment_priority_score::DOUBLE FROM ev "
    "UNION ALL SELECT nuts_code, 'transport_load_score', transport_load_score::DOUBLE FROM tm UNION ALL SELECT nuts_code, 'grid_readiness_proxy_score', grid_readiness_proxy_score::DOUBLE FROM gm UNION ALL SELECT nuts_code, 'renewable_context_score', renewable_context_score::DOUBLE FROM rm "
    "UNION ALL SELECT nuts_code, 'infrastructure_opportunity_score', infrastructure_opportunity_score::DOUBLE FROM io UNION ALL SELECT nuts_code, 'grid_absorption_risk_proxy_score', grid_absorption_risk_proxy_score::DOUBLE FROM em", "ev", "tm", "gm", "rm", "io", "em"))
def model_evaluation(spark, sf):
    a = W.analytics(spark, sf)
    return evaluate_model(a["baseline"], score_model(spark), "nuts_code").select("nuts_code", "indicator_score", score("expected_score"))


@query("verification_checks")
def verification_checks(spark, sf):
    from regionscore.config import RegionConfig
    from regionscore.plans import refresh as R

    return R.verify(W.analytics(spark, sf), RegionConfig(expected_regions=25))


@query("opportunity_summary", sql(
    "SELECT count(*) AS districts, min(infrastructure_opportunity_score)::DOUBLE AS minimum_score, max(infrastructure_opportunity_score)::DOUBLE AS maximum_score, round(sum(infrastructure_opportunity_score) / count(infrastructure_opportunity_score), 1)::DOUBLE AS average_score FROM io", "io"))
def opportunity_summary(spark, sf):
    s = V.opportunity_summary(W.analytics(spark, sf)["opportunity"])
    return s.select("districts", score("minimum_score"), score("maximum_score"), score("average_score"))


@query("energy_summary", sql(
    "SELECT reporting_year, count(*) AS districts, count(*) FILTER (WHERE energy_unavailable_reason IS NULL) AS complete_districts, count(energy_unavailable_reason) AS unavailable_districts, round((min(renewable_balance_ratio) * 100)::DECIMAL(24, 9), 1)::DOUBLE AS minimum_coverage_pct, round((max(renewable_balance_ratio) * 100)::DECIMAL(24, 9), 1)::DOUBLE AS maximum_coverage_pct FROM em GROUP BY reporting_year", "em"))
def energy_summary(spark, sf):
    s = V.energy_summary(W.analytics(spark, sf)["energy"])
    return s.select(big("reporting_year"), "districts", "complete_districts", "unavailable_districts", score("minimum_coverage_pct"), score("maximum_coverage_pct"))


@query("snapshot_context", sql(
    "SELECT max(CAST(o_orderdate AS DATE)) AS charger_snapshot_date, 'orders' AS charger_snapshot_source, NULL::VARCHAR AS charger_snapshot_unavailable_reason FROM orders"))
def snapshot_context(spark, sf):
    dated = W.table(spark, sf, "orders").select(
        F.lit("bnetza_ladesaeulenregister").alias("source_key"), F.to_date("o_orderdate").alias("snapshot_date"), F.lit("orders").alias("source_name"),
        F.lit(None).cast("string").alias("source_note"), F.lit(None).cast("timestamp").alias("recorded_at"),
    )
    return S.snapshot_context(dated.select(*[f.name for f in SOURCE_SNAPSHOTS.fields]))


@query("fast_share", sql(
    "SELECT CASE WHEN u = 0 THEN f END AS fast, CASE WHEN u = 0 THEN t END AS total, CASE WHEN u = 0 THEN round(100 * f / t, 9) END AS percent, CASE WHEN u > 0 THEN 'incomplete_classification' END AS reason FROM (SELECT sum(chargers_total)::DOUBLE AS t, sum(fast_chargers_total)::DOUBLE AS f, sum(unknown_power_chargers_total) AS u FROM met)", "met"))
def fast_share(spark, sf):
    return MD.fast_share(W.analytics(spark, sf)["district_metrics"]).withColumn("percent", r("percent", 9))


@query("kpis", sql(
    "SELECT round(avg(ev_readiness_score::DOUBLE), 9) AS average_readiness, (SELECT nuts_code FROM ev ORDER BY ev_readiness_score DESC NULLS LAST, nuts_code LIMIT 1) AS best_readiness, (SELECT nuts_code FROM ev ORDER BY charger_deficit_score DESC NULLS LAST, nuts_code LIMIT 1) AS most_underserved, (SELECT nuts_code FROM ev ORDER BY investment_priority_score DESC NULLS LAST, nuts_code LIMIT 1) AS highest_priority FROM ev", "ev"))
def kpis(spark, sf):
    return MD.kpis(W.analytics(spark, sf)["baseline"]).withColumn("average_readiness", r("average_readiness", 9))


@query("ranked_districts", sql("SELECT nuts_code, investment_priority_score::DOUBLE AS investment_priority_score FROM ev WHERE investment_priority_score IS NOT NULL ORDER BY 2 DESC, 1", "ev"))
def ranked_districts(spark, sf):
    ranked, _ = MD.ranked_list(W.analytics(spark, sf)["baseline"], "investment_priority_score")
    return ranked.select("nuts_code", score("investment_priority_score"))


@query("unavailable_districts", sql("SELECT nuts_code, energy_unavailable_reason AS reason FROM em WHERE local_energy_balance_score IS NULL", "em"))
def unavailable_districts(spark, sf):
    _, missing = MD.ranked_list(W.analytics(spark, sf)["energy"], "local_energy_balance_score")
    return missing


@query("route_lengths", sql(
    "SELECT trim(road_number) AS route, round(sum(len), 9) AS length FROM (SELECT k, road_number, id, sum(sqrt(((bx - ax) * cos(radians((ay + bz) / 2))) ** 2 + (bz - ay) ** 2)) AS len FROM (SELECT r.k, r.road_number, s.* FROM road r JOIN road_seg s ON r.osm_id = s.id) GROUP BY ALL) WHERE k % 6 <> 0 GROUP BY 1".replace("SELECT r.k, r.road_number, s.*", "SELECT r.k, r.road_number, s.id, s.ax, s.ay, s.bx, s.bz"), "road", "road_seg"))
def route_lengths(spark, sf):
    return RU.route_lengths(W.motorways(spark, sf)).select("route", r("length", 9))


@query("longest_routes", sql(
    "SELECT osm_id AS source_id FROM road WHERE k % 6 <> 0 AND trim(road_number) IN (SELECT trim(road_number) FROM road r JOIN road_seg s ON r.osm_id = s.id WHERE k % 6 <> 0 GROUP BY 1 ORDER BY sum(sqrt(((s.bx - s.ax) * cos(radians((s.ay + s.bz) / 2))) ** 2 + (s.bz - s.ay) ** 2)) DESC, 1 LIMIT 7)", "road", "road_seg"))
def longest_routes(spark, sf):
    return MD.routes_for_zoom(W.motorways(spark, sf), 7).select("source_id")


@query("strongest_station_per_cell", sql(
    "SELECT source_id FROM st QUALIFY row_number() OVER (PARTITION BY floor(lon / 0.25::DOUBLE), floor(lat / 0.25::DOUBLE) ORDER BY power_kw * greatest(coalesce(charging_points, 0), 1) DESC, power_kw DESC, greatest(coalesce(charging_points, 0), 1) DESC, source_id) = 1", "st"))
def strongest_station_per_cell(spark, sf):
    return MD.stations_for_zoom(W.stations(spark, sf), 8).select("source_id")


@query("largest_renewable_per_cell", sql(
    "SELECT source_id FROM re WHERE technology IN ('Windenergie', 'Photovoltaik Freifläche') AND status IN ('', 'In Betrieb') QUALIFY row_number() OVER (PARTITION BY floor(lon / 0.12::DOUBLE), floor(lat / 0.12::DOUBLE), technology ORDER BY coalesce(capacity_mw, 0) DESC, source_id) = 1", "re"))
def largest_renewable_per_cell(spark, sf):
    shown = P.displayed_renewables(W.renewables(spark, sf), blank_status=True)
    return MD.renewables_for_zoom(shown, 9).select("source_id")


@query("published_chargers", sql(
    f"SELECT source_id, operator, charging_points, power_kw, 'Point' AS kind FROM (SELECT st.*, o_orderpriority AS operator FROM st JOIN orders ON o_orderkey = k) st WHERE EXISTS (SELECT 1 FROM d WHERE {INSIDE})", "st", "d"))
def published_chargers(spark, sf):
    layer = P.publish_chargers(W.stations(spark, sf), W.prepared(spark, sf))
    return layer.select("source_id", "operator", big("charging_points"), "power_kw", F.col("geom.type").alias("kind"))


@query("published_regional_roads", sql(
    "SELECT osm_id AS source_id, road_class, road_number, traffic_total FROM road WHERE upper(trim(coalesce(road_class, ''))) IN ('B', 'L')", "road"))
def published_regional_roads(spark, sf):
    return P.publish_regional_roads(W.roads(spark, sf)).select("source_id", "road_class", "road_number", "traffic_total")


@query("published_autobahns", sql("SELECT osm_id AS source_id, CASE WHEN k % 6 <> 0 THEN road_number END AS ref FROM road WHERE k % 4 <> 0", "road"))
def published_autobahns(spark, sf):
    return P.publish_autobahns(W.motorways(spark, sf)).select("source_id", "ref")


@query("published_accessibility", sql(
    "SELECT osm_id, CASE upper(trim(road_class)) WHEN 'A' THEN 'motorway' WHEN 'B' THEN 'primary' WHEN 'L' THEN 'secondary' ELSE lower(trim(road_class)) END AS road_class_normalized FROM road WHERE upper(trim(road_class)) IN ('A', 'B', 'L', 'MOTORWAY')", "road"))
def published_accessibility(spark, sf):
    """All lattice roads lie within the margin of some district, so only the class decides here."""
    return P.publish_accessibility(W.roads(spark, sf), W.prepared(spark, sf)).select("osm_id", "road_class_normalized")


@query("published_grid_readiness", sql("SELECT source_id, asset_type, voltage FROM g", "g"))
def published_grid_readiness(spark, sf):
    return P.publish_grid_readiness(W.grid(spark, sf), W.prepared(spark, sf)).select("source_id", "asset_type", "voltage")


@query("published_renewable_potential", sql("SELECT source_id, technology, capacity_mw, status FROM re", "re"))
def published_renewable_potential(spark, sf):
    layer = P.publish_renewable_potential(W.renewables(spark, sf), W.prepared(spark, sf))
    return layer.select("source_id", "technology", "capacity_mw", "status")


@query("published_grid_absorption_risk", sql(
    "SELECT nuts_code, district_name, energy_data_quality_flag, grid_absorption_risk_proxy_score::DOUBLE AS grid_absorption_risk_proxy_score, CASE WHEN holed THEN 2 ELSE 1 END AS rings FROM em JOIN d USING (nuts_code)", "em", "d"))
def published_grid_absorption_risk(spark, sf):
    layer = P.publish_grid_absorption_risk(W.analytics(spark, sf)["energy"], W.prepared(spark, sf))
    return layer.select("nuts_code", "district_name", "energy_data_quality_flag", score("grid_absorption_risk_proxy_score"), F.size(G.rings(F.col("geom"))).alias("rings"))
