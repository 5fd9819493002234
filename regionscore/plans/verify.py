"""Checks of the analytics after a refresh: each is a query that counts what violates it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionscore.config import DEFAULT, RegionConfig
from regionscore.functions import geometry as G
from regionscore.functions.parsing import finite_or_null
from regionscore.functions.scores import normalize_5_95, round_score
from regionscore.operators.quality import violation
from regionscore.operators.quantiles import one_row
from regionscore.operators.rollups import station_rollup
from regionscore.operators.scoring import evaluate_model
from regionscore.plans.measures import STATION_COUNTS
from regionscore.plans.scenario import BOUND_NAMES

UNAVAILABLE_GRID_FLAGS = ("no_mapped_substation", "no_mapped_grid_lines", "unknown_line_voltage")


def _bad(name: str, df: DataFrame, broken: Column) -> DataFrame:
    return violation(name, df.where(F.coalesce(broken, F.lit(False))))


def _out_of(value: Column, low: float, high: float) -> Column:
    return value.isNotNull() & ~value.between(low, high)


def check_row_count(table: DataFrame, label: str, expected: int) -> DataFrame:
    return table.agg(
        F.lit(f"{label} has {expected} rows").alias("check"), F.abs(F.count("*") - expected).alias("violations")
    )


def check_station_semantics(stations: DataFrame) -> DataFrame:
    """Known points and powers are finite and not negative; unknown power stays NULL."""
    def bad_power(name: str) -> Column:
        value = F.col(name)
        return value.isNotNull() & (finite_or_null(value).isNull() | (value < 0))

    broken = (
        F.col("charging_points").isNull()
        | (F.col("charging_points") < 1)
        | bad_power("power_kw")
        | bad_power("max_point_power_kw")
    )
    return _bad("station points and power are valid", stations, broken)


def check_station_totals(metrics: DataFrame, assigned: DataFrame) -> DataFrame:
    """District totals re-derived from the assigned stations."""
    again = station_rollup(assigned).select("nuts_code", *[F.col(c).alias(f"again_{c}") for c in STATION_COUNTS])
    joined = metrics.join(again, "nuts_code", "left")
    differs = F.lit(False)
    for c in STATION_COUNTS:
        differs = differs | (F.col(c) != F.coalesce(F.col(f"again_{c}"), F.lit(0)))
    classes = F.col("fast_chargers_total") + F.col("normal_chargers_total") + F.col("unknown_power_chargers_total")
    return _bad("district station totals re-derive", joined, differs | (F.col("chargers_total") != classes))


def check_renewable_domain(raw: DataFrame, bounds: DataFrame) -> DataFrame:
    """Operating assets exist and their density really varies."""
    low, high = F.col("renewable_capacity_mw_per_km2_low"), F.col("renewable_capacity_mw_per_km2_high")
    some = raw.agg(
        F.lit("operating renewable domain is not empty").alias("check"),
        F.when(F.coalesce(F.max("renewable_installation_count"), F.lit(0)) > 0, 0).otherwise(1).cast("bigint").alias("violations"),
    )
    varied = bounds.agg(
        F.lit("renewable capacity bounds vary").alias("check"),
        F.when(F.count_if(finite_or_null(low) < finite_or_null(high)) > 0, 0).otherwise(1).cast("bigint").alias("violations"),
    )
    return some.union(varied)


def check_score_model(model: DataFrame) -> DataFrame:
    """Weights sum to one per indicator; bounds come in pairs and only with a measure."""
    low, high = F.col("lower_bound"), F.col("upper_bound")
    unbounded = _bad(
        "model bounds belong to a measure and come in pairs",
        model,
        (F.col("measure").isNull() & (low.isNotNull() | high.isNotNull())) | (low.isNull() != high.isNull()),
    )
    totals = model.groupBy("indicator_score").agg(F.sum(F.abs("component_weight")).alias("weight"))
    empty = model.agg(
        F.lit("score model is published").alias("check"),
        F.when(F.count("*") == 0, 1).otherwise(0).cast("bigint").alias("violations"),
    )
    return empty.union(unbounded).union(violation("indicator weights sum to one", totals.where("weight <> 1.00")))


def check_model_recomputation(scored: DataFrame, model: DataFrame, key: str = "nuts_code") -> DataFrame:
    """Every published composite equals its model terms, and is missing exactly when a part is."""
    again = evaluate_model(scored, model, key)
    return violation(
        "indicators follow the published model",
        again.where(~F.col("expected_score").eqNullSafe(F.col("published_score"))),
    )


def check_opportunity(opportunity: DataFrame) -> DataFrame:
    scores = [
        F.col(c)
        for c in ("transport_load_score", "grid_readiness_proxy_score", "renewable_context_score", "infrastructure_opportunity_score")
    ]
    broken = scores[3].isNull() != (F.col("infrastructure_data_quality_flag") == "missing_required_component")
    for s in scores:
        broken = broken | _out_of(s, 0, 100)
    return _bad("infrastructure scores are in range and explained", opportunity, broken)


def check_transport(transport: DataFrame) -> DataFrame:
    return _bad(
        "a missing transport score is explained",
        transport,
        F.col("transport_load_score").isNull() & (F.col("transport_data_quality_flag") == "complete_traffic_coverage"),
    )


def check_grid(grid: DataFrame) -> DataFrame:
    return _bad(
        "grid flag and grid score agree",
        grid,
        F.col("grid_readiness_proxy_score").isNull() != F.col("grid_data_quality_flag").isin(*UNAVAILABLE_GRID_FLAGS),
    )


def check_baseline(baseline: DataFrame) -> DataFrame:
    """Point density, one formula version, and the years every score needs beside it."""
    density = _bad(
        "point density exceeds station density where stations have several points",
        baseline,
        (F.col("charging_points_total") > F.col("chargers_total"))
        & (F.col("charging_points_per_km2") <= F.col("chargers_per_km2")),
    )
    version = baseline.agg(
        F.lit("one formula version").alias("check"), F.abs(F.count_distinct("formula_version") - 1).alias("violations")
    )
    context = _bad(
        "scores carry version and source years",
        baseline,
        F.col("formula_version").isNull() | F.col("population_source_year").isNull() | F.col("energy_reporting_year").isNull(),
    )
    return density.union(version).union(context)


def check_capacity_kept_apart(baseline: DataFrame, renewable: DataFrame, energy: DataFrame) -> DataFrame:
    """Asset capacity and municipal workbook capacity keep their own values and reasons."""
    pairs = {
        "operating_asset_renewable_capacity_mw": ("a", "renewable_capacity_mw"),
        "operating_asset_renewable_capacity_mw_per_km2": ("a", "renewable_capacity_mw_per_km2"),
        "municipal_workbook_renewable_capacity_mw": ("w", "renewable_capacity_mw"),
        "municipal_workbook_capacity_reporting_year": ("w", "reporting_year"),
        "municipal_workbook_renewable_capacity_coverage": ("w", "renewable_capacity_coverage"),
        "municipal_workbook_renewable_capacity_unavailable_reason": ("w", "renewable_capacity_unavailable_reason"),
    }
    joined = baseline.alias("d").join(renewable.alias("a"), "nuts_code").join(energy.alias("w"), "nuts_code")
    broken = F.lit(False)
    for mine, (side, theirs) in pairs.items():
        broken = broken | ~F.col(f"d.{mine}").eqNullSafe(F.col(f"{side}.{theirs}"))
    return _bad("asset and workbook capacity are kept apart", joined, broken)


def check_rank_ties(scored: DataFrame, score: str = "investment_priority_score", rank: str = "priority_rank") -> DataFrame:
    """Rows with the same score share one rank (one aggregate instead of pairing the rows)."""
    return violation(
        "equal scores share a rank", scored.groupBy(score).agg(F.count_distinct(rank).alias("n")).where("n > 1")
    )


def check_energy(energy: DataFrame) -> DataFrame:
    """One year, flag and reason agree, coverage is consistent, scores exist where inputs do."""
    year = energy.agg(
        F.lit("one energy reporting year").alias("check"),
        F.abs(F.count_distinct("reporting_year") - 1).alias("violations"),
    )
    missing = F.col("energy_data_quality_flag") == "missing_required_input"
    reason = _bad("energy flag and reason agree", energy, missing != F.col("energy_unavailable_reason").isNotNull())
    expected = F.col("expected_municipalities")
    used, stock = F.col("consumption_municipalities_reported"), F.col("renewable_municipalities_reported")
    years, wanted = F.col("growth_years_reported"), F.col("growth_years_required")
    coverage = (
        F.coalesce(used > expected, F.lit(False))
        | F.coalesce(stock > expected, F.lit(False))
        | F.coalesce(years > wanted, F.lit(False))
        | F.coalesce(F.col("consumption_mwh").isNotNull() & (used != expected), F.lit(False))
        | F.coalesce(F.col("renewable_net_addition_3y_mw").isNotNull() & (years != wanted), F.lit(False))
    )
    risk = F.col("grid_absorption_risk_proxy_score")
    parts = (F.col("local_energy_balance_score"), F.col("renewable_growth_score"), F.col("grid_readiness_proxy_score"))
    again = 0.45 * parts[0].cast("double") + 0.30 * parts[1].cast("double") + 0.25 * (100 - parts[2].cast("double"))
    scores = (risk.isNull() != missing) | (
        risk.isNotNull()
        & (
            _out_of(parts[0], 0, 100)
            | _out_of(parts[1], 0, 100)
            | _out_of(risk, 0, 100)
            | (F.abs(risk.cast("double") - round_score(again).cast("double")) > 0.05)
        )
    )
    some = energy.agg(
        F.lit("some district has complete consumption").alias("check"),
        F.when(F.count("consumption_mwh") == 0, 1).otherwise(0).cast("bigint").alias("violations"),
    )
    return (
        year.union(reason)
        .union(_bad("energy totals only with complete coverage", energy, coverage))
        .union(_bad("energy scores are consistent and in range", energy, scores))
        .union(some)
    )


def check_energy_reconciliation(
    energy: DataFrame, consumption: DataFrame, renewable: DataFrame, config: RegionConfig = DEFAULT
) -> DataFrame:
    """Published district totals equal the municipal inputs of the districts that publish one."""
    year = one_row(energy.agg(F.max("reporting_year").alias("y")))["y"]
    published = energy.where(F.col("consumption_mwh").isNotNull())
    with_generation = energy.where(F.col("total_renewable_generation_mwh").isNotNull())
    used = consumption.where(F.col("year") == year).join(published, "nuts_code", "left_semi")
    made = renewable.where(F.col("year") == year).join(with_generation, "nuts_code", "left_semi")
    totals = published.agg(
        F.sum("consumption_mwh").alias("c"), F.sum("total_renewable_generation_mwh").alias("g")
    )
    c = one_row(used.agg((F.sum("consumption_gwh") * 1000.0).alias("v")))["v"]
    g = one_row(
        made.agg(
            F.sum(F.col("published_generation_mwh") + F.col("wind_capacity_mw") * config.wind_full_load_hours).alias("v")
        )
    )["v"]
    off = (F.abs(F.col("c") - c) > 0.01) | (F.abs(F.col("g") - g) > 0.01)
    return totals.agg(
        F.lit("district energy totals reconcile to municipal inputs").alias("check"),
        F.count_if(F.coalesce(off, F.lit(False))).alias("violations"),
    )


def check_layer(
    table: DataFrame, label: str, required: Iterable[str], kinds: Iterable[str], *, geom: str = "geom"
) -> DataFrame:
    """Required columns exist, geometry has the right kind, positions are longitude and latitude."""
    absent = sorted(set(required) - set(table.columns))
    missing = table.sparkSession.range(1).select(
        F.lit(f"{label}: required columns").alias("check"), F.lit(len(absent)).cast("bigint").alias("violations")
    )
    if geom not in table.columns:
        return missing
    position_ok = F.forall(
        G.positions(F.col(geom)), lambda p: p["x"].between(-180.0, 180.0) & p["y"].between(-90.0, 90.0)
    )
    wrong_kind = ~F.coalesce(F.col(f"{geom}.type").isin(*kinds), F.lit(False))
    outside = G.is_empty(F.col(geom)) | ~F.coalesce(position_ok, F.lit(False))
    return (
        missing.union(_bad(f"{label}: geometry kind", table, wrong_kind)).union(
            _bad(f"{label}: longitude and latitude", table, outside)
        )
    )


COVERAGE_FIELDS = (
    "consumption_municipal_coverage", "renewable_municipal_coverage", "municipal_workbook_renewable_capacity_coverage",
    "traffic_length_coverage", "line_voltage_coverage", "substation_voltage_coverage",
)
CONTEXT_FIELDS = (
    "district_name", "formula_version", "population_source_year", "energy_reporting_year", "expected_municipalities",
    "growth_years_required",
)
BASELINE_SCORES = ("ev_readiness_score", "charger_deficit_score", "infrastructure_opportunity_score", "investment_priority_score")
TRANSPORT_SCORES = ("traffic_intensity_score", "traffic_road_density_score", "road_proximity_score", "transport_load_score")
GRID_SCORES = ("substation_proximity_score", "voltage_line_density_score", "substation_density_score", "grid_readiness_proxy_score")
ENERGY_SCORES = ("local_energy_balance_score", "renewable_growth_score", "grid_absorption_risk_proxy_score")


def _any_null(names: Iterable[str]) -> Column:
    result = F.lit(False)
    for n in names:
        result = result | F.col(n).isNull()
    return result


def check_district_contract(baseline: DataFrame, config: RegionConfig = DEFAULT) -> DataFrame:
    """Context present, coverages 0-1, scores 0-100, and each flag with exactly what it promises."""
    keys = baseline.groupBy("nuts_code").count().where("count > 1 or coalesce(nuts_code, '') = ''")
    coverage, scores = F.lit(False), F.lit(False)
    for c in COVERAGE_FIELDS:
        coverage = coverage | _out_of(F.col(c), 0.0, 1.0)
    for c in [c for c in baseline.columns if c.endswith("_score")]:
        scores = scores | _out_of(F.col(c), 0, 100)
    flag, t, g, e = (
        F.col(c)
        for c in ("data_quality_flag", "transport_data_quality_flag", "grid_data_quality_flag", "energy_data_quality_flag")
    )
    ev = F.when(flag == "complete_proxy_inputs", _any_null(BASELINE_SCORES)).otherwise(
        ~F.coalesce(flag.isin("missing_ev_input", "missing_infrastructure_input"), F.lit(False))
    )
    transport = (
        F.when(t == "complete_traffic_coverage", _any_null(TRANSPORT_SCORES))
        .when(t.isin("no_counted_road_network", "no_published_traffic_value"), F.col("transport_load_score").isNotNull())
        .otherwise(~F.coalesce(t == "partial_traffic_coverage", F.lit(False)))
    )
    grid = (
        F.when(g == "complete_grid_inputs", _any_null(GRID_SCORES))
        .when(g.isin(*UNAVAILABLE_GRID_FLAGS), F.col("grid_readiness_proxy_score").isNotNull())
        .otherwise(~F.coalesce(g == "partial_line_voltage", F.lit(False)))
    )
    all_parts = ~_any_null(("local_energy_balance_score", "renewable_growth_score", "grid_readiness_proxy_score"))
    reason = F.coalesce("energy_unavailable_reason", F.lit(""))
    energy = (
        F.when(
            e == "missing_required_input",
            (reason == "") | F.col("grid_absorption_risk_proxy_score").isNotNull() | all_parts,
        )
        .when(
            e.isin("hybrid_complete", "published_complete_no_wind"),
            F.col("energy_unavailable_reason").isNotNull() | _any_null(ENERGY_SCORES),
        )
        .otherwise(F.lit(True))
    )
    return (
        check_row_count(baseline, "district layer", config.expected_regions)
        .union(violation("district identities are unique", keys))
        .union(_bad("district context is present", baseline, _any_null(CONTEXT_FIELDS)))
        .union(_bad("coverages are ratios", baseline, coverage))
        .union(_bad("scores are within 0-100", baseline, scores))
        .union(_bad("baseline flag matches its scores", baseline, ev))
        .union(_bad("transport flag matches its scores", baseline, transport))
        .union(_bad("grid flag matches its score", baseline, grid))
        .union(_bad("energy flag matches reason and scores", baseline, energy))
    )


SCENARIO_SCORES = (
    "charger_density_score", "charger_accessibility_score", "population_adjusted_coverage_score", "ev_readiness_score",
    "charger_deficit_score", "investment_priority_score",
)
COMPONENTS = (
    ("charger_density_score", "charging_points_per_km2", False),
    ("charger_accessibility_score", "distance_to_nearest_charger_m", True),
    ("population_adjusted_coverage_score", "charging_points_per_100k_population", False),
)
TOLERANCE = 0.051


def _far(left: Column, right: Column) -> Column:
    return F.abs(left.cast("double") - right.cast("double")) > TOLERANCE


def check_scenario(after: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Deltas add up, scores recompute from the published bounds, the baseline never moves."""
    delta, recomputed = F.lit(False), F.lit(False)
    for name in SCENARIO_SCORES:
        s, b = F.col(f"scenario_{name}"), F.col(f"baseline_{name}")
        delta = delta | F.coalesce(_far(s.cast("double") - b.cast("double"), F.col(f"{name}_delta")), F.lit(False))
        delta = delta | F.coalesce(_out_of(s, 0, 100), F.lit(False))
    for phase in ("baseline", "scenario"):
        for score, measure, inverse in COMPONENTS:
            bound = BOUND_NAMES[measure]
            expected = round_score(
                normalize_5_95(
                    F.col(f"{phase}_{measure}"), F.col(f"{bound}_lower_bound"), F.col(f"{bound}_upper_bound"), inverse
                )
            )
            recomputed = recomputed | F.coalesce(_far(F.col(f"{phase}_{score}"), expected), F.lit(False))
    checks = _bad("scenario deltas equal scenario minus baseline", after, delta).union(
        _bad("scenario components follow the fixed bounds", after, recomputed)
    )
    if before is None:
        return checks
    joined = after.alias("a").join(before.alias("b"), "nuts_code")
    moved = F.lit(False)
    for name in SCENARIO_SCORES:
        moved = moved | ~F.col(f"a.baseline_{name}").eqNullSafe(F.col(f"b.baseline_{name}"))
    return checks.union(_bad("proposals do not move the baseline", joined, moved))


def check_proposal_added(before: DataFrame, after: DataFrame, code: str, points: int) -> DataFrame:
    """One proposal adds one station and its points to its district and to no other."""
    joined = after.alias("a").join(before.alias("b"), "nuts_code")
    hit = F.col("nuts_code") == code
    stations = F.col("a.scenario_chargers_total") - F.col("b.scenario_chargers_total")
    added = F.col("a.scenario_charging_points_total") - F.col("b.scenario_charging_points_total")
    wrong = (stations != F.when(hit, 1).otherwise(0)) | (added != F.when(hit, points).otherwise(0))
    return _bad("a proposal adds exactly itself", joined, wrong)


def check_restored(before: DataFrame, restored: DataFrame) -> DataFrame:
    names = ("scenario_chargers_total", "scenario_charging_points_total", "scenario_priority_rank", "data_quality_flag")
    names += tuple(f"scenario_{n}" for n in SCENARIO_SCORES)
    joined = before.alias("b").join(restored.alias("r"), "nuts_code", "full_outer")
    changed = F.lit(False)
    for n in names:
        changed = changed | ~F.col(f"b.{n}").eqNullSafe(F.col(f"r.{n}"))
    return _bad("deleting a proposal restores the scenario", joined, changed)


def opportunity_summary(opportunity: DataFrame) -> DataFrame:
    score = F.col("infrastructure_opportunity_score")
    return opportunity.agg(
        F.count("*").alias("districts"),
        F.min(score).alias("minimum_score"),
        F.max(score).alias("maximum_score"),
        F.round(F.avg(score), 1).alias("average_score"),
    )


def energy_summary(energy: DataFrame) -> DataFrame:
    share, risk = F.col("renewable_coverage_pct"), F.col("grid_absorption_risk_proxy_score")
    return energy.groupBy("reporting_year").agg(
        F.count("*").alias("districts"),
        F.count_if(F.col("energy_unavailable_reason").isNull()).alias("complete_districts"),
        F.count_if(F.col("energy_unavailable_reason").isNotNull()).alias("unavailable_districts"),
        F.round(F.min(share).cast("decimal(24,12)"), 1).alias("minimum_coverage_pct"),
        F.round(F.max(share).cast("decimal(24,12)"), 1).alias("maximum_coverage_pct"),
        F.round(F.avg(risk), 1).alias("average_risk_score"),
    )
