"""Municipal energy panel to district balance: coverage gates, reasons and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionscore.config import DEFAULT, RegionConfig
from regionscore.functions.scores import gated, ratio
from regionscore.operators.quantiles import one_row
from regionscore.operators.rollups import complete_window, municipal_universe, panel_rollup, reporting_year
from regionscore.operators.scoring import with_components, with_composite


def energy_balance_raw(
    districts: DataFrame, consumption: DataFrame, renewable: DataFrame, config: RegionConfig = DEFAULT
) -> DataFrame:
    """District totals of the reporting year, each published only with complete coverage.

    ``districts`` needs ``nuts_code, ags, district_name, area_km2``.
    """
    year_table = reporting_year(consumption, renewable)
    year = one_row(year_table)["reporting_year"]
    universe = municipal_universe(consumption, renewable)
    used = panel_rollup(
        consumption,
        year,
        {"consumption_reported": F.col("consumption_gwh")},
        {"consumption_municipalities": F.col("consumption_gwh").isNotNull()},
    )
    sources = consumption.where(F.col("year") == year).groupBy("nuts_code").agg(F.min("source").alias("energy_source"))
    stock = panel_rollup(
        renewable,
        year,
        {
            "generation_reported": F.col("published_generation_mwh"),
            "wind_reported": F.col("wind_capacity_mw"),
            "capacity_reported": F.col("renewable_capacity_mw"),
            "unknown_components": F.col("generation_components_unknown"),
        },
        {
            "stock_municipalities": F.col("published_generation_mwh").isNotNull()
            & F.col("wind_capacity_mw").isNotNull(),
            "capacity_municipalities": F.col("renewable_capacity_mw").isNotNull(),
        },
    )
    growth = complete_window(
        renewable, universe, year, config.growth_window_years, "renewable_net_addition_mw"
    )
    joined = (
        districts.select("nuts_code", "ags", "district_name", "area_km2")
        .join(universe, "nuts_code", "left")
        .join(used, "nuts_code", "left")
        .join(sources, "nuts_code", "left")
        .join(stock, "nuts_code", "left")
        .join(growth, "nuts_code", "left")
    )
    expected = F.col("expected_municipalities")
    generation = gated(F.col("generation_reported"), F.col("stock_municipalities"), expected)
    wind = gated(F.col("wind_reported"), F.col("stock_municipalities"), expected)
    hours = F.lit(config.wind_full_load_hours)
    addition = gated(F.col("net_addition_reported"), F.col("growth_years_reported"), F.lit(config.growth_window_years))
    staged = joined.withColumns(
        {
            "consumption_mwh": gated(F.col("consumption_reported") * 1000.0, F.col("consumption_municipalities"), expected),
            "published_generation_mwh": generation,
            "wind_capacity_mw": wind,
            "estimated_wind_generation_mwh": wind * hours,
            "total_renewable_generation_mwh": generation + wind * hours,
            "renewable_capacity_mw": gated(F.col("capacity_reported"), F.col("capacity_municipalities"), expected),
            "renewable_net_addition_3y_mw": addition,
        }
    )
    return staged.select(
        "nuts_code",
        "ags",
        "district_name",
        year.alias("reporting_year"),
        "area_km2",
        "expected_municipalities",
        F.coalesce("consumption_municipalities", F.lit(0)).alias("consumption_municipalities_reported"),
        F.coalesce("stock_municipalities", F.lit(0)).alias("renewable_municipalities_reported"),
        F.coalesce("capacity_municipalities", F.lit(0)).alias("renewable_capacity_municipalities_reported"),
        F.lit(config.growth_window_years).alias("growth_years_required"),
        F.coalesce("growth_years_reported", F.lit(0)).alias("growth_years_reported"),
        F.coalesce("unknown_components", F.lit(0)).cast("bigint").alias("generation_components_unknown"),
        "energy_source",
        "consumption_mwh",
        "published_generation_mwh",
        "wind_capacity_mw",
        "estimated_wind_generation_mwh",
        "total_renewable_generation_mwh",
        "renewable_capacity_mw",
        "renewable_net_addition_3y_mw",
        (F.col("renewable_net_addition_3y_mw") / F.nullif(F.col("area_km2"), F.lit(0.0))).alias(
            "renewable_growth_density_mw_per_km2"
        ),
        F.when(
            F.col("consumption_mwh") > 0,
            F.col("total_renewable_generation_mwh") / F.nullif(F.col("consumption_mwh"), F.lit(0.0)),
        ).alias("renewable_balance_ratio"),
        hours.alias("wind_full_load_hours"),
    )


def local_energy_balance(raw: DataFrame, bounds: DataFrame, grid: DataFrame) -> DataFrame:
    """Scores, coverage ratios, and why a required input is unavailable (first reason wins)."""
    scored = with_components(raw, "grid_absorption_risk_proxy_score", bounds).join(
        grid.select("nuts_code", "grid_readiness_proxy_score"), "nuts_code", "left"
    )
    scored = with_composite(scored, "grid_absorption_risk_proxy_score")
    inputs = [F.col(c) for c in ("local_energy_balance_score", "renewable_growth_score", "grid_readiness_proxy_score")]
    missing = inputs[0].isNull() | inputs[1].isNull() | inputs[2].isNull()
    expected = F.col("expected_municipalities")
    return scored.withColumns(
        {
            "consumption_municipal_coverage": ratio(F.col("consumption_municipalities_reported"), expected),
            "renewable_municipal_coverage": ratio(F.col("renewable_municipalities_reported"), expected),
            "renewable_capacity_coverage": ratio(F.col("renewable_capacity_municipalities_reported"), expected),
            "renewable_coverage_pct": F.col("renewable_balance_ratio") * 100.0,
            "energy_data_quality_flag": F.when(missing, "missing_required_input")
            .when(F.col("wind_capacity_mw") > 0, "hybrid_complete")
            .otherwise("published_complete_no_wind"),
            "energy_unavailable_reason": F.when(expected.isNull(), "no_municipal_energy_data")
            .when(F.col("consumption_mwh").isNull(), "incomplete_consumption_coverage")
            .when(F.col("consumption_mwh") <= 0, "zero_consumption_denominator")
            .when(
                F.col("published_generation_mwh").isNull() | F.col("wind_capacity_mw").isNull(),
                "incomplete_renewable_coverage",
            )
            .when(F.col("renewable_net_addition_3y_mw").isNull(), "incomplete_growth_window")
            .when(inputs[2].isNull(), "unavailable_grid_readiness_proxy"),
            "renewable_capacity_unavailable_reason": F.when(expected.isNull(), "no_municipal_energy_data").when(
                F.col("renewable_capacity_mw").isNull(), "incomplete_capacity_coverage"
            ),
        }
    )
