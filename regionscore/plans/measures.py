"""Per-district measurements: the only place where spatial work happens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionscore.config import DEFAULT, RegionConfig
from regionscore.functions import geometry as G
from regionscore.functions.parsing import voltage_kv
from regionscore.functions.projection import with_utm
from regionscore.operators.nearest import nearest
from regionscore.operators.region_index import RegionIndex, build_index
from regionscore.operators.relational import left_join_any
from regionscore.operators.rollups import (
    renewable_rollup,
    station_rollup,
    substation_rollup,
    weighted_length_rollup,
)
from regionscore.operators.spatial import (
    assign_regions,
    clip_lengths,
    intersect_pairs,
    nearest_feature,
    point_segments,
    with_region_measures,
)
from regionscore.storage import materialize

STATION_COUNTS = (
    "chargers_total",
    "charging_points_total",
    "fast_chargers_total",
    "normal_chargers_total",
    "unknown_power_chargers_total",
)


@dataclass(frozen=True)
class Districts:
    """Districts with stored projected outlines, plus the two grids every join reuses."""

    table: DataFrame
    index: RegionIndex
    metric_index: RegionIndex

    @property
    def measures(self) -> DataFrame:
        return self.table.select("nuts_code", "area_km2", "centroid_x", "centroid_y")


def staging_districts(regions: DataFrame, config: RegionConfig = DEFAULT) -> DataFrame:
    return regions.where(F.col("nuts_code").startswith(config.region_prefix))


def prepare_districts(regions: DataFrame, config: RegionConfig = DEFAULT) -> Districts:
    """Project once, store, and build the grids."""
    table = materialize(with_region_measures(staging_districts(regions, config)), "districts")
    return Districts(
        table=table,
        index=build_index(table, "nuts_code", "geom"),
        metric_index=build_index(table, "nuts_code", "geom_m", metric=True),
    )


def station_owners(stations: DataFrame, districts: Districts) -> DataFrame:
    """Each station with its one district: the lowest code on a shared border."""
    return assign_regions(stations, point_id="source_id", index=districts.index)


def station_distance(stations: DataFrame, districts: Districts, *, cell: float | None = None) -> DataFrame:
    """Metres from each district centroid to the nearest of all stations, wherever they are."""
    usable = stations.where(G.finite(F.col("lon")) & G.finite(F.col("lat"))).select("source_id", "lon", "lat")
    segments = point_segments(with_utm(usable, "lon", "lat"), "source_id", "x", "y")
    found = nearest(districts.measures, segments, origin_id="nuts_code", feature_id="source_id", cell=cell)
    return found.select("nuts_code", F.col("distance_m").alias("distance_to_nearest_charger_m"))


def population_of(districts: DataFrame, population: DataFrame) -> DataFrame:
    """Population rows of each district by either code, with how often the same figure occurs.

    A district that meets two different figures has two rows; the same figure met twice is one
    row whose ``copies`` is two.
    """
    keyed = population.select(
        "nuts_code", "ags", "population", "reference_year", "source", F.monotonically_increasing_id().alias("row_id")
    )
    pairs = left_join_any(
        districts.select("nuts_code", "ags"),
        keyed,
        [("nuts_code", "nuts_code"), ("ags", "ags")],
        left_id="nuts_code",
        right_id="row_id",
    )
    return pairs.groupBy(
        "nuts_code",
        "population",
        F.col("reference_year").alias("population_source_year"),
        F.col("source").alias("population_source"),
    ).agg(F.count("*").alias("copies"))


def district_metrics(
    districts: Districts, stations: DataFrame, population: DataFrame, *, cell: float | None = None
) -> DataFrame:
    """Area, population, station roll-up and nearest station of every district."""
    rolled = station_rollup(station_owners(stations, districts))
    people = population_of(districts.table, population)
    joined = (
        districts.table.select("nuts_code", "ags", "district_name", "area_km2")
        .join(people, "nuts_code")
        .join(rolled, "nuts_code", "left")
        .join(station_distance(stations, districts, cell=cell), "nuts_code", "left")
    )
    counts = {c: F.coalesce(F.col(c), F.lit(0)) * F.col("copies") for c in STATION_COUNTS}
    return joined.withColumns(counts).select(
        "nuts_code",
        "ags",
        "district_name",
        "area_km2",
        "population",
        "population_source_year",
        "population_source",
        *STATION_COUNTS,
        "distance_to_nearest_charger_m",
    )


def transport_raw(districts: Districts, roads: DataFrame, *, cell: float | None = None) -> DataFrame:
    """Road length, measured share, traffic intensity and density, nearest road."""
    parts = clip_lengths(
        roads,
        districts.table,
        line_id="osm_id",
        keep=["traffic_total"],
        index=districts.index,
        metric_index=districts.metric_index,
    )
    rolled = weighted_length_rollup(parts, "traffic_total")
    close = nearest_feature(districts.measures, roads, origin_id="nuts_code", feature_id="osm_id", cell=cell)
    return (
        districts.measures.join(rolled, "nuts_code", "left")
        .join(close, "nuts_code", "left")
        .select(
            "nuts_code",
            F.coalesce("length_km", F.lit(0.0)).alias("traffic_road_length_km"),
            F.coalesce("known_length_km", F.lit(0.0)).alias("traffic_measured_length_km"),
            F.col("length_coverage").alias("traffic_length_coverage"),
            F.col("weighted_mean").alias("traffic_intensity_dtv"),
            (F.col("weighted_km") / F.nullif(F.col("area_km2"), F.lit(0.0))).alias("traffic_weighted_road_density"),
            F.col("distance_m").alias("distance_to_nearest_road_m"),
        )
    )


def grid_raw(
    districts: Districts, grid: DataFrame, config: RegionConfig = DEFAULT, *, cell: float | None = None
) -> DataFrame:
    """Line lengths by known voltage, substations and the nearest substation."""
    parsed = grid.withColumn("voltage_kv", voltage_kv(F.col("voltage")))
    lines = parsed.where(F.col("asset_type").isin(*config.line_assets))
    substations = parsed.where(F.col("asset_type").isin(*config.substation_assets))
    line_agg = weighted_length_rollup(
        clip_lengths(
            lines,
            districts.table,
            line_id="source_id",
            keep=["voltage_kv"],
            index=districts.index,
            metric_index=districts.metric_index,
        ),
        "voltage_kv",
    )
    station_agg = substation_rollup(
        intersect_pairs(substations, "source_id", districts.index, keep=["voltage_kv"])
    )
    close = nearest_feature(districts.measures, substations, origin_id="nuts_code", feature_id="source_id", cell=cell)
    area = F.nullif(F.col("area_km2"), F.lit(0.0))
    substation_count = F.coalesce("substation_count", F.lit(0))
    return (
        districts.measures.join(line_agg, "nuts_code", "left")
        .join(station_agg, "nuts_code", "left")
        .join(close, "nuts_code", "left")
        .select(
            "nuts_code",
            F.coalesce("length_km", F.lit(0.0)).alias("grid_line_length_km"),
            F.coalesce("known_length_km", F.lit(0.0)).alias("grid_line_length_km_known_voltage"),
            F.coalesce("parts", F.lit(0)).alias("grid_line_segments"),
            substation_count.alias("substation_count"),
            "maximum_mapped_voltage_kv",
            F.col("part_coverage").alias("line_voltage_coverage"),
            "substation_voltage_coverage",
            (F.col("weighted_km") / area).alias("voltage_weighted_line_density"),
            (substation_count / area).alias("substation_density"),
            F.col("distance_m").alias("distance_to_nearest_substation_m"),
        )
    )


def renewable_raw(districts: Districts, renewables: DataFrame, config: RegionConfig = DEFAULT) -> DataFrame:
    """Operating renewable assets of every district; a border asset counts on both sides."""
    operating = renewables.where(F.col("status") == config.operating_status)
    hits = assign_regions(
        operating.select("source_id", "technology", "capacity_mw", "lon", "lat"),
        point_id="source_id",
        ambiguous="all",
        index=districts.index,
    )
    capacity = F.coalesce("renewable_capacity_mw", F.lit(0.0))
    return (
        districts.measures.join(renewable_rollup(hits), "nuts_code", "left")
        .select(
            "nuts_code",
            F.coalesce("renewable_installation_count", F.lit(0)).alias("renewable_installation_count"),
            capacity.alias("renewable_capacity_mw"),
            F.coalesce("renewable_technology_count", F.lit(0)).alias("renewable_technology_count"),
            (capacity / F.nullif(F.col("area_km2"), F.lit(0.0))).alias("renewable_capacity_mw_per_km2"),
        )
    )
