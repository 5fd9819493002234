"""Scores over the measurements; always recomputed, so parts and composites cannot drift apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionscore import config as C
from regionscore.config import DEFAULT, RegionConfig
from regionscore.operators.quantiles import bounds, one_row, rank_desc_nulls_last
from regionscore.operators.scoring import measures_of, normalize_and_combine, with_components, with_composite
from regionscore.storage import materialize


def transport_bounds(raw: DataFrame) -> DataFrame:
    return bounds(raw, measures_of("transport_load_score"))


def grid_bounds(raw: DataFrame) -> DataFrame:
    return bounds(raw, measures_of("grid_readiness_proxy_score"))


def renewable_bounds(raw: DataFrame) -> DataFrame:
    return bounds(raw, measures_of("renewable_context_score"))


def energy_bounds(raw: DataFrame) -> DataFrame:
    return bounds(raw, measures_of("grid_absorption_risk_proxy_score"))


def ev_bounds(raw: DataFrame) -> DataFrame:
    return bounds(raw, measures_of("ev_readiness_score"))


def transport_metrics(raw: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    scored = normalize_and_combine(raw, "transport_load_score", bound or transport_bounds(raw))
    return scored.withColumn(
        "transport_data_quality_flag",
        F.when(F.col("traffic_road_length_km") == 0, "no_counted_road_network")
        .when(F.col("traffic_measured_length_km") == 0, "no_published_traffic_value")
        .when(F.col("traffic_length_coverage") < 1, "partial_traffic_coverage")
        .otherwise("complete_traffic_coverage"),
    )


def grid_metrics(raw: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    scored = normalize_and_combine(raw, "grid_readiness_proxy_score", bound or grid_bounds(raw))
    return scored.withColumn(
        "grid_data_quality_flag",
        F.when(F.col("distance_to_nearest_substation_m").isNull(), "no_mapped_substation")
        .when(F.col("grid_line_segments") == 0, "no_mapped_grid_lines")
        .when(F.coalesce("line_voltage_coverage", F.lit(0.0)) == 0, "unknown_line_voltage")
        .when(F.col("line_voltage_coverage") < 1, "partial_line_voltage")
        .otherwise("complete_grid_inputs"),
    )


def renewable_metrics(raw: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    return normalize_and_combine(raw, "renewable_context_score", bound or renewable_bounds(raw))


def infrastructure_opportunity(
    metrics: DataFrame, transport: DataFrame, grid: DataFrame, renewable: DataFrame
) -> DataFrame:
    parts = ("transport_load_score", "grid_readiness_proxy_score", "renewable_context_score")
    joined = metrics.select(
        "nuts_code", "ags", "district_name", "area_km2", "population", "chargers_total", "charging_points_total"
    )
    for table, score in zip((transport, grid, renewable), parts):
        joined = joined.join(table.select("nuts_code", score), "nuts_code", "left")
    missing = F.col(parts[0]).isNull() | F.col(parts[1]).isNull() | F.col(parts[2]).isNull()
    return with_composite(joined, "infrastructure_opportunity_score").withColumn(
        "infrastructure_data_quality_flag",
        F.when(missing, "missing_required_component").otherwise("complete_proxy_inputs"),
    )


def ev_measures(metrics: DataFrame) -> DataFrame:
    """Densities and points per head from counts, area and population."""
    area = F.nullif(F.col("area_km2"), F.lit(0.0))
    people = F.nullif(F.col("population").cast("double"), F.lit(0.0))
    return metrics.withColumns(
        {
            "charging_points_per_km2": F.col("charging_points_total") / area,
            "chargers_per_km2": F.col("chargers_total") / area,
            "charging_points_per_100k_population": F.col("charging_points_total") * 100000.0 / people,
        }
    )


def ev_readiness(measured: DataFrame, bound: DataFrame) -> DataFrame:
    """Components, readiness and deficit alone, ranked by readiness."""
    scored = with_composite(with_components(measured, "ev_readiness_score", bound), "ev_readiness_score")
    scored = with_composite(scored, "charger_deficit_score")
    return rank_desc_nulls_last(scored, "ev_readiness_score", "readiness_rank")


def ev_scores(measured: DataFrame, bound: DataFrame, opportunity: DataFrame) -> DataFrame:
    """Readiness, deficit, priority, flag and rank from EV measures and (fixed) bounds."""
    scored = with_components(measured, "ev_readiness_score", bound)
    scored = with_composite(with_composite(scored, "ev_readiness_score"), "charger_deficit_score")
    scored = scored.join(
        opportunity.select("nuts_code", "infrastructure_opportunity_score").dropDuplicates(["nuts_code"]),
        "nuts_code",
        "left",
    )
    scored = with_composite(scored, "investment_priority_score").withColumn(
        "data_quality_flag",
        F.when(F.col("ev_readiness_score").isNull(), "missing_ev_input")
        .when(F.col("infrastructure_opportunity_score").isNull(), "missing_infrastructure_input")
        .otherwise("complete_proxy_inputs"),
    )
    return rank_desc_nulls_last(materialize(scored, "scored"), "investment_priority_score", "priority_rank")


def formula_version(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(
        F.lit(C.FORMULA_VERSION).alias("formula_version"),
        F.to_date(F.lit(C.FORMULA_VERSION_DATE)).alias("formula_version_date"),
        F.lit(C.SUPERSEDED_FORMULA_VERSION).alias("supersedes_formula_version"),
        F.lit(C.FORMULA_NOTE).alias("formula_version_note"),
    )


def energy_assumptions(spark: SparkSession, config: RegionConfig = DEFAULT) -> DataFrame:
    return spark.range(1).select(
        F.lit(config.wind_full_load_hours).alias("wind_full_load_hours"),
        F.lit(config.growth_window_years).alias("renewable_growth_window_years"),
        F.lit(C.WIND_NOTE).alias("wind_estimate_note"),
    )


def traffic_assumptions(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in C.TRAFFIC_ASSUMPTIONS.items()])


TRANSPORT_DETAIL = (
    "transport_load_score", "traffic_intensity_score", "traffic_road_density_score", "road_proximity_score",
    "traffic_intensity_dtv", "traffic_weighted_road_density", "traffic_road_length_km",
    "traffic_measured_length_km", "traffic_length_coverage", "distance_to_nearest_road_m",
    "transport_data_quality_flag",
)
GRID_DETAIL = (
    "grid_readiness_proxy_score", "substation_proximity_score", "voltage_line_density_score",
    "substation_density_score", "voltage_weighted_line_density", "substation_density",
    "distance_to_nearest_substation_m", "grid_line_length_km", "substation_count",
    "maximum_mapped_voltage_kv", "line_voltage_coverage", "substation_voltage_coverage",
    "grid_data_quality_flag",
)
RENEWABLE_DETAIL = {
    "renewable_context_score": "renewable_context_score",
    "renewable_capacity_density_score": "renewable_capacity_density_score",
    "renewable_technology_diversity_score": "renewable_technology_diversity_score",
    "operating_asset_renewable_capacity_mw": "renewable_capacity_mw",
    "operating_asset_renewable_capacity_mw_per_km2": "renewable_capacity_mw_per_km2",
    "renewable_capacity_mw_per_km2": "renewable_capacity_mw_per_km2",
    "renewable_technology_count": "renewable_technology_count",
    "renewable_installation_count": "renewable_installation_count",
}
ENERGY_DETAIL = {
    "energy_reporting_year": "reporting_year",
    "energy_source": "energy_source",
    "local_energy_balance_score": "local_energy_balance_score",
    "renewable_growth_score": "renewable_growth_score",
    "grid_absorption_risk_proxy_score": "grid_absorption_risk_proxy_score",
    "renewable_balance_ratio": "renewable_balance_ratio",
    "renewable_coverage_pct": "renewable_coverage_pct",
    "consumption_mwh": "consumption_mwh",
    "published_generation_mwh": "published_generation_mwh",
    "estimated_wind_generation_mwh": "estimated_wind_generation_mwh",
    "total_renewable_generation_mwh": "total_renewable_generation_mwh",
    "renewable_net_addition_3y_mw": "renewable_net_addition_3y_mw",
    "renewable_growth_density_mw_per_km2": "renewable_growth_density_mw_per_km2",
    "expected_municipalities": "expected_municipalities",
    "consumption_municipal_coverage": "consumption_municipal_coverage",
    "renewable_municipal_coverage": "renewable_municipal_coverage",
    "municipal_workbook_renewable_capacity_mw": "renewable_capacity_mw",
    "municipal_workbook_capacity_reporting_year": "reporting_year",
    "municipal_workbook_renewable_capacity_coverage": "renewable_capacity_coverage",
    "growth_years_required": "growth_years_required",
    "growth_years_reported": "growth_years_reported",
    "energy_data_quality_flag": "energy_data_quality_flag",
    "energy_unavailable_reason": "energy_unavailable_reason",
    "municipal_workbook_renewable_capacity_unavailable_reason": "renewable_capacity_unavailable_reason",
}


def snapshot_context(snapshots: DataFrame, config: RegionConfig = DEFAULT) -> DataFrame:
    """One row: when and by whom the station source was published, or that nobody recorded it."""
    found = snapshots.where(F.col("source_key") == config.station_source_key).agg(
        F.max("snapshot_date").alias("charger_snapshot_date"), F.max("source_name").alias("charger_snapshot_source")
    )
    return found.withColumn(
        "charger_snapshot_unavailable_reason",
        F.when(F.col("charger_snapshot_date").isNull(), "charger_snapshot_date_not_recorded"),
    )


def ev_baseline(
    scored: DataFrame,
    transport: DataFrame,
    grid: DataFrame,
    renewable: DataFrame,
    energy: DataFrame,
    opportunity: DataFrame,
    snapshots: DataFrame,
    config: RegionConfig = DEFAULT,
) -> DataFrame:
    """The canonical district row: every component, coverage, source and reason by district key."""
    wide = (
        scored.join(transport.select("nuts_code", *TRANSPORT_DETAIL), "nuts_code", "left")
        .join(grid.select("nuts_code", *GRID_DETAIL), "nuts_code", "left")
        .join(renewable.select("nuts_code", *[F.col(v).alias(k) for k, v in RENEWABLE_DETAIL.items()]), "nuts_code", "left")
        .join(energy.select("nuts_code", *[F.col(v).alias(k) for k, v in ENERGY_DETAIL.items()]), "nuts_code", "left")
        .join(
            opportunity.select("nuts_code", "infrastructure_data_quality_flag").dropDuplicates(["nuts_code"]),
            "nuts_code",
            "left",
        )
    )
    context = one_row(snapshot_context(snapshots, config))
    constants = {c: F.lit(v) for c, v in (
        ("wind_full_load_hours", config.wind_full_load_hours),
        ("renewable_growth_window_years", config.growth_window_years),
        ("wind_estimate_note", C.WIND_NOTE),
        ("formula_version", C.FORMULA_VERSION),
    )}
    constants["formula_version_date"] = F.to_date(F.lit(C.FORMULA_VERSION_DATE))
    for name in ("charger_snapshot_date", "charger_snapshot_source", "charger_snapshot_unavailable_reason"):
        constants[name] = context[name]
    return wide.withColumns(constants)
