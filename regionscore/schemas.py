"""Table schemas and the published column layouts (fixed values of the public surface)."""

from __future__ import annotations

from pyspark.sql import types as T

from regionscore.functions.geometry import GEOMETRY

_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DISTRICTS = _table(nuts_code=_S, ags=_S, district_name=_S, region_name=_S, geom=GEOMETRY)
STATIONS = _table(
    source_id=_S, operator=_S, status=_S, charger_type=_S, charging_points=_I, power_kw=_D, max_point_power_kw=_D,
    street=_S, postcode=_S, city=_S, district_text=_S, bundesland=_S, lon=_D, lat=_D,
)
POPULATION = _table(district_code=_S, nuts_code=_S, ags=_S, population=_I, reference_year=_I, source=_S)
ROADS = _table(
    osm_id=_S, road_class=_S, name=_S, road_number=_S, traffic_total=_D, traffic_light=_D, traffic_heavy=_D,
    counting_station_type=_S, source=_S, geom=GEOMETRY,
)
GRID = _table(source_id=_S, asset_type=_S, voltage=_S, name=_S, geom=GEOMETRY)
MOTORWAYS = _table(source_id=_S, highway=_S, ref=_S, name=_S, geom=GEOMETRY)
RENEWABLES = _table(
    source_id=_S, name=_S, operator=_S, asset_type=_S, technology=_S, capacity_mw=_D, status=_S, lon=_D, lat=_D
)
POWER_PLANTS = _table(
    source_id=_S, name=_S, operator=_S, energy_source=_S, technology=_S, capacity_mw=_D, status=_S, voltage=_S,
    network_operator=_S, lon=_D, lat=_D,
)
ENERGY_CONSUMPTION = _table(
    year=_I, municipality_name=_S, district_name=_S, nuts_code=_S, ags=_S, consumption_gwh=_D, industry_gwh=_D,
    commerce_services_gwh=_D, households_gwh=_D, source=_S,
)
RENEWABLE_BALANCE = _table(
    year=_I, municipality_name=_S, district_name=_S, nuts_code=_S, ags=_S, published_generation_mwh=_D,
    generation_components_unknown=_I, wind_capacity_mw=_D, renewable_capacity_mw=_D, renewable_net_addition_mw=_D,
    source=_S,
)
PROPOSALS = _table(
    id=_S, name=_S, charging_points=_I, power_kw=_D, max_point_power_kw=_D, request_id=_S, nuts_code=_S, status=_S,
    created_at=T.TimestampType(), lon=_D, lat=_D,
)
SOURCE_SNAPSHOTS = _table(
    source_key=_S, snapshot_date=T.DateType(), source_name=_S, source_note=_S, recorded_at=T.TimestampType()
)
INGEST_RUNS = _table(ingest_run_id=_S, recorded_at=T.TimestampType())
INGEST_INPUTS = _table(
    ingest_run_id=_S, source_key=_S, source_path=_S, bytes=_L, sha256=_S, provenance=_S, provenance_sha256=_S
)

PUBLISHED = {
    "chargers": (
        "source_id", "operator", "status", "charger_type", "charging_points", "power_kw", "max_point_power_kw",
        "street", "postcode", "city", "district_text", "bundesland", "geom",
    ),
    "grid_readiness": ("source_id", "asset_type", "voltage", "name", "geom"),
    "renewable_potential": (
        "source_id", "name", "operator", "asset_type", "technology", "capacity_mw", "status", "geom",
    ),
    "accessibility": (
        "osm_id", "road_class", "name", "road_number", "traffic_total", "traffic_light", "traffic_heavy", "source",
        "geom", "road_class_normalized",
    ),
    "autobahns": ("source_id", "highway", "ref", "name", "geom"),
    "regional_roads": (
        "source_id", "road_class", "road_number", "name", "traffic_total", "traffic_light", "traffic_heavy", "source",
        "geom",
    ),
    "local_energy_balance": (
        "nuts_code", "ags", "district_name", "reporting_year", "energy_source", "expected_municipalities",
        "consumption_municipalities_reported", "consumption_municipal_coverage", "renewable_municipalities_reported",
        "renewable_municipal_coverage", "renewable_capacity_municipalities_reported", "renewable_capacity_coverage",
        "renewable_capacity_unavailable_reason", "growth_years_required", "growth_years_reported",
        "generation_components_unknown", "energy_unavailable_reason", "consumption_mwh", "published_generation_mwh",
        "estimated_wind_generation_mwh", "total_renewable_generation_mwh", "renewable_capacity_mw",
        "renewable_net_addition_3y_mw", "renewable_growth_density_mw_per_km2", "renewable_balance_ratio",
        "renewable_coverage_pct", "local_energy_balance_score", "energy_data_quality_flag", "wind_full_load_hours",
        "geom",
    ),
    "grid_absorption_risk": (
        "nuts_code", "ags", "district_name", "reporting_year", "energy_unavailable_reason",
        "renewable_net_addition_3y_mw", "renewable_growth_density_mw_per_km2", "renewable_growth_score",
        "grid_readiness_proxy_score", "local_energy_balance_score", "grid_absorption_risk_proxy_score",
        "energy_data_quality_flag", "geom",
    ),
}
