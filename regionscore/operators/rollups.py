"""Per-region roll-ups. NULL is unknown, 0 is measured, a partial sum is never a total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionscore.config import DEFAULT
from regionscore.functions.scores import gated


def station_rollup(
    assigned: DataFrame,
    *,
    region_id: str = "nuts_code",
    points: str = "charging_points",
    power: str = "max_point_power_kw",
    threshold_kw: float = DEFAULT.fast_threshold_kw,
) -> DataFrame:
    """Stations, points (an unknown point count is one) and power classes per region."""
    kw = F.col(power)
    return assigned.groupBy(region_id).agg(
        F.count("*").alias("chargers_total"),
        F.sum(F.coalesce(F.col(points), F.lit(1))).cast("bigint").alias("charging_points_total"),
        F.count_if(kw >= threshold_kw).alias("fast_chargers_total"),
        F.count_if(kw < threshold_kw).alias("normal_chargers_total"),
        F.count_if(kw.isNull()).alias("unknown_power_chargers_total"),
    )


def weighted_length_rollup(parts: DataFrame, weight: str, *, region_id: str = "nuts_code") -> DataFrame:
    """Lengths, the share with a known weight, and length-weighted sums and means.

    A part with an unknown weight adds length but leaves the weighted sum and its denominator.
    """
    length, w = F.col("length_km"), F.col(weight)
    total, known = F.sum(length), F.sum(F.when(w.isNotNull(), length))
    weighted = F.sum(length * w)
    return parts.groupBy(region_id).agg(
        total.alias("length_km"),
        known.alias("known_length_km"),
        (known / F.nullif(total, F.lit(0.0))).alias("length_coverage"),
        weighted.alias("weighted_km"),
        (weighted / F.nullif(known, F.lit(0.0))).alias("weighted_mean"),
        F.count("*").alias("parts"),
        (F.count(w) / F.nullif(F.count("*"), F.lit(0))).alias("part_coverage"),
    )


def substation_rollup(pairs: DataFrame, *, region_id: str = "nuts_code", voltage: str = "voltage_kv") -> DataFrame:
    return pairs.groupBy(region_id).agg(
        F.count("*").alias("substation_count"),
        F.max(voltage).alias("maximum_mapped_voltage_kv"),
        (F.count(voltage) / F.nullif(F.count("*"), F.lit(0))).alias("substation_voltage_coverage"),
    )


def renewable_rollup(assigned: DataFrame, *, region_id: str = "nuts_code") -> DataFrame:
    capacity = F.col("capacity_mw")
    return assigned.groupBy(region_id).agg(
        F.count("*").alias("renewable_installation_count"),
        F.sum(capacity).alias("renewable_capacity_mw"),
        F.count_distinct(F.when(capacity > 0, F.col("technology"))).alias("renewable_technology_count"),
    )


def reporting_year(consumption: DataFrame, renewable: DataFrame, year: str = "year") -> DataFrame:
    """The latest year both inputs have; the renewable side needs yield and wind capacity known."""
    usable = renewable.where(F.col("published_generation_mwh").isNotNull() & F.col("wind_capacity_mw").isNotNull())
    common = consumption.select(year).distinct().join(usable.select(year).distinct(), year)
    return common.agg(F.max(year).alias("reporting_year"))


def municipal_universe(
    consumption: DataFrame, renewable: DataFrame, *, region_id: str = "nuts_code", member: str = "ags"
) -> DataFrame:
    """How many municipalities either input has ever reported for a region."""
    seen = consumption.select(region_id, member).union(renewable.select(region_id, member)).distinct()
    return seen.groupBy(region_id).agg(F.count(member).alias("expected_municipalities"))


def panel_rollup(
    panel: DataFrame,
    year: Column,
    sums: dict[str, Column],
    reported: dict[str, Column],
    *,
    region_id: str = "nuts_code",
) -> DataFrame:
    """Sums and reported counts of one year of a yearly panel."""
    return (
        panel.where(F.col("year") == year)
        .groupBy(region_id)
        .agg(
            *[F.count_if(c).alias(name) for name, c in reported.items()],
            *[F.sum(c).alias(name) for name, c in sums.items()],
        )
    )


def complete_window(
    panel: DataFrame, universe: DataFrame, year: Column, years: int, value: str, *, region_id: str = "nuts_code"
) -> DataFrame:
    """``(region, years_reported, value)`` over a trailing window.

    A year counts only when every expected municipality reported it; the value is the sum over
    all years and may only be published when every year counts.
    """
    by_year = (
        panel.where(F.col("year").between(year - (years - 1), year))
        .groupBy(region_id, "year")
        .agg(F.count(value).alias("reported"), F.sum(value).alias("total"))
    )
    return (
        by_year.join(universe, region_id)
        .groupBy(region_id)
        .agg(
            F.count_if(F.col("reported") == F.col("expected_municipalities")).alias("growth_years_reported"),
            F.sum("total").alias("net_addition_reported"),
        )
    )


def gated_sum(total: Column, reported: Column, expected: Column) -> Column:
    return gated(total, reported, expected)


def sum_known(df: DataFrame, columns: Sequence[str]) -> Column:
    """Row-wise sum of the columns that exist; a present but empty member makes it unknown."""
    present = [F.col(f"`{c}`").cast("double") for c in columns if c in df.columns]
    total = F.lit(0.0)
    for c in present:
        total = total + c
    return total


YIELD_SUFFIX = "Stromertrag (MWh)"
CAPACITY_SUFFIX = "Leistung (MW)"


def sum_yield(df: DataFrame, columns: Sequence[str]) -> tuple[Column, Column]:
    """``(total or NULL, unknown count)`` of yields.

    An empty yield beside a capacity of zero is a true zero; beside a positive or unknown
    capacity it is a yield that was not published.
    """
    total, unknown = F.lit(0.0), F.lit(0)
    for name in columns:
        if name not in df.columns:
            continue
        value = F.col(f"`{name}`").cast("double")
        partner = name.replace(YIELD_SUFFIX, CAPACITY_SUFFIX)
        no_plant = (
            F.coalesce(F.col(f"`{partner}`").cast("double") == 0, F.lit(False))
            if partner in df.columns
            else F.lit(False)
        )
        missing = value.isNull() & ~no_plant
        total = total + F.coalesce(value, F.lit(0.0))
        unknown = unknown + missing.cast("int")
    return F.when(unknown == 0, total), unknown


def route_lengths(lines: DataFrame, *, geom: str = "geom", ref: str = "ref") -> DataFrame:
    """Route lengths by trimmed reference; lines without one are left out."""
    from regionscore.functions.geometry import scaled_degree_length

    route = F.nullif(F.trim(F.col(ref)), F.lit(""))
    return (
        lines.select(route.alias("route"), scaled_degree_length(F.col(geom)).alias("length"))
        .where(F.col("route").isNotNull())
        .groupBy("route")
        .agg(F.sum("length").alias("length"))
    )
