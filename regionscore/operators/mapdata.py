"""What a map or dashboard reads: thinning by cell, top routes, ranked lists, shares and KPIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionscore.functions.parsing import finite_or_null, technology_group
from regionscore.operators.quantiles import one_row
from regionscore.operators.rollups import route_lengths

# Routes and cell sizes by zoom level; other levels show everything.
ROUTES_BY_ZOOM = {6: 4, 7: 7, 8: 12}
STATION_CELLS = {6: 0.75, 7: 0.45, 8: 0.25, 9: 0.12}
RENEWABLE_CELLS = {6: 0.75, 7: 0.45, 8: 0.25, 9: 0.12, 10: 0.06, 11: 0.03}


def _by_zoom(table: dict[int, float], zoom: int):
    return table.get(max(zoom, min(table)))


def top_routes(lines: DataFrame, k: int | None, *, geom: str = "geom", ref: str = "ref") -> DataFrame:
    """All lines of the k longest routes, ties by name; without k every line."""
    if not k:
        return lines
    longest = route_lengths(lines, geom=geom, ref=ref).orderBy(F.desc("length"), F.asc("route")).limit(k)
    return (
        lines.withColumn("__route", F.trim(F.col(ref)))
        .join(longest, F.col("__route") == F.col("route"), "left_semi")
        .drop("__route")
    )


def routes_for_zoom(lines: DataFrame, zoom: int, *, geom: str = "geom", ref: str = "ref") -> DataFrame:
    return top_routes(lines, _by_zoom(ROUTES_BY_ZOOM, zoom), geom=geom, ref=ref)


def thin_by_cell(
    df: DataFrame, size: float | None, order: Sequence[Column], *, lon: str = "lon", lat: str = "lat", group: Column | None = None
) -> DataFrame:
    """The best row per cell (and group): ``order`` columns compare from first to last, lowest wins.

    A plain partial aggregate, so a cell holding a third of all rows is reduced before it moves.
    Rows without a position drop out; without a cell size everything stays.
    """
    if not size:
        return df
    keys = [F.floor(F.col(lon) / size).alias("__cx"), F.floor(F.col(lat) / size).alias("__cy")]
    if group is not None:
        keys.append(group.alias("__group"))
    row = F.struct(*[F.col(c) for c in df.columns])
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).groupBy(*keys).agg(F.min_by(row, key).alias("__row"))
    return best.select("__row.*")


def _number(name: str) -> Column:
    return F.coalesce(finite_or_null(F.col(name)), F.lit(0.0))


def stations_for_zoom(stations: DataFrame, zoom: int, *, ident: str = "source_id") -> DataFrame:
    """The strongest station per cell; stations without a point position always stay."""
    size = _by_zoom(STATION_CELLS, zoom)
    if not size:
        return stations
    power = _number("power_kw")
    points = F.greatest(
        *[_number(c) for c in ("charging_points", "connectors") if c in stations.columns], F.lit(1.0)
    )
    best = thin_by_cell(stations, size, [-(power * points), -power, -points, F.col(ident)])
    return best.unionByName(stations.where(F.col("lon").isNull() | F.col("lat").isNull()))


def renewables_for_zoom(renewables: DataFrame, zoom: int, *, ident: str = "source_id") -> DataFrame:
    """The largest asset per cell and technology group."""
    order = [-_number("capacity_mw"), F.col(ident)]
    return thin_by_cell(renewables, _by_zoom(RENEWABLE_CELLS, zoom), order, group=technology_group(F.col("technology")))


def unavailable_reason(df: DataFrame, metric: str) -> Column:
    names = [f"{metric}_unavailable_reason", "energy_unavailable_reason", "charger_snapshot_unavailable_reason", "data_quality_flag"]
    present = [F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present, F.lit("No published reason is available."))


def ranked_list(df: DataFrame, metric: str, *, key: str = "nuts_code") -> tuple[DataFrame, DataFrame]:
    """``(ranked by score then code, unavailable with the reason)``."""
    ranked = df.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), F.asc(key))
    missing = df.where(F.col(metric).isNull()).select(key, unavailable_reason(df, metric).alias("reason"))
    return ranked, missing


def fast_share(df: DataFrame, prefix: str = "") -> DataFrame:
    """One row ``(fast, total, percent, reason)``: the share is exact or it is unavailable."""
    total, fast, unknown = (
        finite_or_null(F.col(prefix + c)) for c in ("chargers_total", "fast_chargers_total", "unknown_power_chargers_total")
    )
    gap = total.isNull() | fast.isNull() | unknown.isNull()
    sums = df.agg(
        F.coalesce(F.bool_or(gap), F.lit(False)).alias("gap"),
        F.coalesce(F.sum(total), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(fast), F.lit(0.0)).alias("fast"),
        F.coalesce(F.sum(unknown), F.lit(0.0)).alias("unknown"),
    )
    t, f, u = F.col("total"), F.col("fast"), F.col("unknown")
    reason = (
        F.when(F.col("gap") | (t < 0) | (f < 0) | (u < 0), "missing_counts")
        .when(t == 0, "zero_total")
        .when((f + u > t) | (u > 0), "incomplete_classification")
    )
    return sums.withColumn("reason", reason).select(
        F.when(F.col("reason").isNull(), f).alias("fast"),
        F.when(F.col("reason").isNull(), t).alias("total"),
        F.when(F.col("reason").isNull(), 100.0 * f / F.nullif(t, F.lit(0.0))).alias("percent"),
        "reason",
    )


def fast_share_change(df: DataFrame) -> DataFrame:
    """Percentage-point change of the fast share, available only when both shares are."""
    before, after = one_row(fast_share(df, "baseline_")), one_row(fast_share(df, "scenario_"))
    return df.sparkSession.range(1).select(
        before["percent"].alias("baseline_percent"),
        after["percent"].alias("scenario_percent"),
        (after["percent"] - before["percent"]).alias("percentage_points"),
        F.coalesce(before["reason"], after["reason"]).alias("reason"),
    )


FAST_SHARE_REASONS = {
    "zero_total": "No stations are available, so a fast-share percentage cannot be calculated.",
    "incomplete_classification": "Some stations have unknown maximum point power, so the fast-share percentage is unavailable.",
    "missing_counts": "Fast, total, or maximum-point-power classification counts are unavailable.",
}


def kpis(df: DataFrame, *, key: str = "nuts_code") -> DataFrame:
    """Mean readiness over available districts, and the districts leading three rankings."""

    def leader(metric: str) -> Column:
        """The highest score; the lowest code among equals."""
        ordering = F.struct((-F.col(metric)).alias("s"), F.col(key).alias("k"))
        return F.min_by(F.col(key), F.when(F.col(metric).isNotNull(), ordering))

    return df.agg(
        F.avg(F.col("ev_readiness_score").cast("double")).alias("average_readiness"),
        leader("ev_readiness_score").alias("best_readiness"),
        leader("charger_deficit_score").alias("most_underserved"),
        leader("investment_priority_score").alias("highest_priority"),
    )
