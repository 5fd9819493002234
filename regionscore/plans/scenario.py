"""What-if comparison: official stations plus proposals against the fixed baseline scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionscore.functions.parsing import valid_coordinates
from regionscore.operators.quantiles import one_row
from regionscore.operators.region_index import RegionIndex
from regionscore.operators.relational import split_valid
from regionscore.operators.rollups import station_rollup
from regionscore.operators.spatial import region_matches
from regionscore.plans.measures import STATION_COUNTS, Districts, station_distance, station_owners
from regionscore.plans.scores import ev_measures, ev_scores

COMPARED = (
    "chargers_total",
    "charging_points_total",
    "fast_chargers_total",
    "normal_chargers_total",
    "unknown_power_chargers_total",
    "charging_points_per_km2",
    "chargers_per_km2",
    "charging_points_per_100k_population",
    "distance_to_nearest_charger_m",
    "charger_density_score",
    "charger_accessibility_score",
    "population_adjusted_coverage_score",
    "ev_readiness_score",
    "charger_deficit_score",
    "investment_priority_score",
)
# The names the comparison publishes the baseline bounds under.
BOUND_NAMES = {
    "charging_points_per_km2": "charging_point_density",
    "distance_to_nearest_charger_m": "charger_distance",
    "charging_points_per_100k_population": "population_coverage",
}


def effective_stations(stations: DataFrame, proposals: DataFrame) -> DataFrame:
    """Official and proposed stations under prefixed ids."""
    shared = ("charging_points", "power_kw", "max_point_power_kw", "lon", "lat")
    official = stations.select(F.concat(F.lit("official:"), F.col("source_id")).alias("source_id"), *shared)
    proposed = proposals.select(F.concat(F.lit("proposal:"), F.col("id")).alias("source_id"), *shared)
    return official.unionByName(proposed)


def _station_measures(metrics: DataFrame, counts: DataFrame, distance: DataFrame) -> DataFrame:
    base = metrics.select("nuts_code", "ags", "district_name", "area_km2", "population")
    joined = base.join(counts, "nuts_code", "left").join(distance, "nuts_code", "left")
    return ev_measures(joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in STATION_COUNTS}))


def scenario_measures_full(
    districts: Districts, metrics: DataFrame, stations: DataFrame, proposals: DataFrame, *, cell: float | None = None
) -> DataFrame:
    """Everything recomputed from the union of official and proposed stations."""
    every = effective_stations(stations, proposals)
    counts = station_rollup(station_owners(every, districts))
    return _station_measures(metrics, counts, station_distance(every, districts, cell=cell))


def scenario_measures(
    districts: Districts, metrics: DataFrame, proposals: DataFrame, *, cell: float | None = None
) -> DataFrame:
    """The same result from the stored baseline plus the proposals alone.

    Official stations neither move nor change owner, so counts add up and the nearest station is
    the nearer of the official and the nearest proposed one. Work grows with the proposals only.
    """
    proposed = proposals.select(
        F.col("id").alias("source_id"), "charging_points", "power_kw", "max_point_power_kw", "lon", "lat"
    )
    added = station_rollup(station_owners(proposed, districts)).select(
        "nuts_code", *[F.col(c).alias(f"added_{c}") for c in STATION_COUNTS]
    )
    close = station_distance(proposed, districts, cell=cell).withColumnRenamed("distance_to_nearest_charger_m", "added_m")
    joined = (
        metrics.select(
            "nuts_code", "ags", "district_name", "area_km2", "population", *STATION_COUNTS, "distance_to_nearest_charger_m"
        )
        .join(added, "nuts_code", "left")
        .join(close, "nuts_code", "left")
    )
    merged = joined.withColumns(
        {c: F.col(c) + F.coalesce(F.col(f"added_{c}"), F.lit(0)) for c in STATION_COUNTS}
        | {"distance_to_nearest_charger_m": F.least("distance_to_nearest_charger_m", "added_m")}
    )
    return ev_measures(merged.drop("added_m", *[f"added_{c}" for c in STATION_COUNTS]))


def scenario_compare(
    measures: DataFrame, baseline: DataFrame, bounds: DataFrame, opportunity: DataFrame
) -> DataFrame:
    """Baseline, scenario and difference of every compared measure, both ranks, and the bounds."""
    scenario = ev_scores(measures, bounds, opportunity)
    context = ("nuts_code", "ags", "district_name", "area_km2", "population", "infrastructure_opportunity_score", "data_quality_flag")
    s = scenario.select(
        *context, *[F.col(c).alias(f"scenario_{c}") for c in COMPARED], F.col("priority_rank").alias("scenario_priority_rank")
    )
    b = baseline.select(
        "nuts_code",
        *[F.col(c).alias(f"baseline_{c}") for c in COMPARED],
        F.col("priority_rank").alias("baseline_priority_rank"),
        "formula_version",
    )
    joined = s.join(b, "nuts_code")
    row = one_row(bounds)
    limits = {}
    for measure, name in BOUND_NAMES.items():
        limits[f"{name}_lower_bound"] = row[f"{measure}_low"]
        limits[f"{name}_upper_bound"] = row[f"{measure}_high"]
    deltas = {f"{c}_delta": F.col(f"scenario_{c}") - F.col(f"baseline_{c}") for c in COMPARED}
    return joined.withColumns(deltas | limits)


def project_view(compared: DataFrame, mode: str) -> DataFrame:
    """One column per measure for the chosen view: baseline, scenario or change.

    Context that no proposal can alter changes by zero only where it is known at all.
    """
    if mode not in ("baseline", "scenario", "change"):
        raise ValueError(f"unknown view: {mode}")
    pick = {c: F.col(f"{c}_delta" if mode == "change" else f"{mode}_{c}") for c in COMPARED}
    context = F.col("infrastructure_opportunity_score")
    if mode == "change":
        context = F.when(context.isNotNull(), F.lit(0).cast(compared.schema["infrastructure_opportunity_score"].dataType))
    rank = F.col("baseline_priority_rank" if mode == "baseline" else "scenario_priority_rank")
    return compared.withColumns(
        pick
        | {
            "infrastructure_opportunity_score": context,
            "priority_rank": rank,
            "scenario_view_mode": F.lit(mode),
        }
    )


def coverage_issue(scenario: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: why the scenario rows may not replace the baseline, or NULL."""
    def usable(code):
        return F.coalesce(F.length(code) > 0, F.lit(False))

    base = baseline.where(usable(F.col("nuts_code"))).select("nuts_code").distinct()
    named = scenario.where(usable(F.col("nuts_code"))).select("nuts_code")
    counts = (
        base.withColumn("b", F.lit(1))
        .join(named.groupBy("nuts_code").agg(F.count("*").alias("s")), "nuts_code", "full_outer")
        .agg(
            F.count("b").alias("expected"),
            F.coalesce(F.sum("s"), F.lit(0)).alias("named"),
            F.count("s").alias("distinct_named"),
            F.count_if(F.col("s").isNull()).alias("missing"),
            F.coalesce(F.sum(F.when(F.col("b").isNull(), F.col("s"))), F.lit(0)).alias("unexpected"),
        )
    )
    total = one_row(scenario.agg(F.count("*").alias("n")))["n"]
    return counts.select(
        F.when(F.col("expected") == 0, "baseline district coverage is unavailable")
        .when(
            (total != F.col("named")) | (F.col("distinct_named") != F.col("named")),
            "scenario metrics have missing or duplicate district identifiers",
        )
        .when(
            (F.col("missing") > 0) | (F.col("unexpected") > 0),
            F.format_string(
                "scenario metrics do not cover the canonical baseline districts (%d missing, %d unexpected)",
                "missing",
                "unexpected",
            ),
        )
        .alias("issue")
    )


def proposal_rules() -> dict:
    """Row rules of a proposal, in the order they are reported."""
    name = F.regexp_replace(F.coalesce("name", F.lit("")), r"^\s+|\s+\z", "")
    top, power = F.col("max_point_power_kw"), F.col("power_kw")
    limit = F.lit(float("inf"))
    return {
        "name_length": F.length(name).between(1, 120),
        "charging_points_range": F.col("charging_points").between(1, 100),
        "power_range": ~F.isnan(power) & power.between(1.0, 1000.0),
        "max_point_power_required": top.isNotNull(),
        "max_point_power_range": ~F.isnan(top) & (top > 0) & (top < limit) & (top <= power),
        "coordinates": valid_coordinates(F.col("lon"), F.col("lat")),
    }


def validate_proposals(proposals: DataFrame, index: RegionIndex) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; an accepted proposal lies in exactly one district and gets its code.

    A point on a district line is rejected rather than assigned: the proposer is to move it.
    """
    trimmed = proposals.drop("nuts_code").withColumn("name", F.regexp_replace("name", r"^\s+|\s+\z", ""))
    passed, rejected = split_valid(trimmed, proposal_rules())
    # places are looked up, not ids: an id may be delivered many times
    places = passed.select("lon", "lat").distinct().withColumn("place", F.concat_ws(" ", F.hex(F.col("lon").cast("string")), F.hex(F.col("lat").cast("string"))))
    located = region_matches(places, index, "place").select("lon", "lat", "regions")
    placed = passed.join(located, ["lon", "lat"], "left").select(*passed.columns, "regions")
    owners = F.coalesce(F.size("regions"), F.lit(0))
    accepted = placed.where(owners == 1).withColumns(
        {"nuts_code": F.get("regions", F.lit(0)), "status": F.lit("proposed")}
    ).drop("regions")
    outside = placed.where(owners != 1).drop("regions").withColumn("reason", F.lit("district"))
    return accepted, rejected.unionByName(outside)


def current_proposals(log: DataFrame) -> DataFrame:
    """Current state of an append-only log ``(id, op, at, ...)``: the latest row per id, not deleted.

    Among rows of one time a delete wins; equal inserts of one time are one row, chosen by its content.
    """
    row = F.struct(*[F.col(c) for c in log.columns])
    order = F.struct(F.col("at"), (F.col("op") == "delete").alias("gone"), F.xxhash64(*[F.col(c) for c in log.columns]).alias("h"))
    latest = log.groupBy(F.col("id").alias("__id")).agg(F.max_by(row, order).alias("r"))
    return latest.select("r.*").where(F.col("op") != "delete").drop("op")


def delete_proposals(
    log: DataFrame, at, *, ids: DataFrame | None = None, owner: str | None = None
) -> DataFrame:
    """Tombstones for the given ids, for one client's proposals, or for everything proposed."""
    current = current_proposals(log)
    if ids is not None:
        current = current.join(ids.select("id").distinct(), "id", "left_semi")
    if owner is not None:
        current = current.where(F.col("client_id") == owner)
    return current.withColumns({"op": F.lit("delete"), "at": at}).select(*log.columns)


def station_total(official: DataFrame, proposed: DataFrame, mode: str, available: bool = True) -> DataFrame:
    """Stations shown in a view; a failed official read is unknown, not zero."""
    n = one_row(official.agg(F.count("*").alias("n")))["n"] if available else F.lit(None).cast("bigint")
    added = F.col("added")
    shown = {"baseline": n, "scenario": n + added, "change": F.when(F.lit(available), added)}[mode]
    return proposed.agg(F.count("*").alias("added")).select(shown.alias("stations"))
