"""Published layers: fixed columns, one geometry, nothing computed here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionscore.config import DEFAULT, RegionConfig
from regionscore.functions import geometry as G
from regionscore.functions.parsing import is_displayed_technology, road_class
from regionscore.operators.spatial import in_any_region, within_distance
from regionscore.plans.measures import Districts
from regionscore.schemas import PUBLISHED


def with_point_geometry(points: DataFrame) -> DataFrame:
    return points.withColumn("geom", G.point(F.col("lon"), F.col("lat")))


def with_district_geometry(table: DataFrame, districts: Districts) -> DataFrame:
    """Attach outlines last, by key, so no earlier step carries polygons."""
    return table.join(districts.table.select("nuts_code", "geom"), "nuts_code")


def publish_chargers(stations: DataFrame, districts: Districts) -> DataFrame:
    inside = in_any_region(stations, index=districts.index)
    return with_point_geometry(inside).select(*PUBLISHED["chargers"])


def publish_grid_readiness(grid: DataFrame, districts: Districts, config: RegionConfig = DEFAULT) -> DataFrame:
    near = within_distance(grid, districts.table, feature_id="source_id", metres=config.context_margin_m)
    return near.select(*PUBLISHED["grid_readiness"])


def publish_renewable_potential(
    renewables: DataFrame, districts: Districts, config: RegionConfig = DEFAULT
) -> DataFrame:
    near = within_distance(
        with_point_geometry(renewables), districts.table, feature_id="source_id", metres=config.context_margin_m
    )
    return near.select(*PUBLISHED["renewable_potential"])


def publish_accessibility(roads: DataFrame, districts: Districts, config: RegionConfig = DEFAULT) -> DataFrame:
    """Major roads (by mapped class) in the districts or their margin."""
    normalized = roads.withColumn("road_class_normalized", road_class(F.col("road_class"), config.road_class_mapping))
    major = normalized.where(F.col("road_class_normalized").isin(*config.major_road_classes))
    near = within_distance(major, districts.table, feature_id="osm_id", metres=config.context_margin_m)
    return near.select(*PUBLISHED["accessibility"])


def publish_autobahns(motorways: DataFrame) -> DataFrame:
    return motorways.where(F.col("highway") == "motorway").select(*PUBLISHED["autobahns"])


def publish_regional_roads(roads: DataFrame, config: RegionConfig = DEFAULT) -> DataFrame:
    kind = road_class(F.col("road_class"), config.road_class_mapping)
    return (
        roads.where(kind.isin("primary", "secondary"))
        .withColumnRenamed("osm_id", "source_id")
        .select(*PUBLISHED["regional_roads"])
    )


def publish_local_energy_balance(energy: DataFrame, districts: Districts) -> DataFrame:
    return with_district_geometry(energy, districts).select(*PUBLISHED["local_energy_balance"])


def publish_grid_absorption_risk(energy: DataFrame, districts: Districts) -> DataFrame:
    return with_district_geometry(energy, districts).select(*PUBLISHED["grid_absorption_risk"])


def publish_scenario(compared: DataFrame, districts: Districts) -> DataFrame:
    return with_district_geometry(compared, districts)


def displayed_renewables(
    renewables: DataFrame, config: RegionConfig = DEFAULT, *, blank_status: bool = False
) -> DataFrame:
    """Assets the map shows: two technologies, operating; the map side also takes a blank status."""
    status = F.col("status") == config.operating_status
    if blank_status:
        text = F.trim(F.coalesce("status", F.lit("")))
        status = (text == "") | (text == config.operating_status)
    return renewables.where(is_displayed_technology(F.col("technology")) & status)
