"""Parameters every operator reads; the defaults are fixed values of the published model."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RegionConfig:
    region_name: str = "Nordrhein-Westfalen"
    region_prefix: str = "DEA"
    ags_prefix: str = "05"
    expected_regions: int = 53
    default_bounds: tuple[float, float, float, float] = (5.86, 50.32, 9.47, 52.53)
    context_margin_m: float = 10_000.0
    fast_threshold_kw: float = 50.0
    percentiles: tuple[float, float] = (0.05, 0.95)
    wind_full_load_hours: float = 2000.0
    growth_window_years: int = 3
    stale_after_days: int = 30
    central_meridian: float = 9.0
    major_road_classes: tuple[str, ...] = ("motorway", "trunk", "primary", "secondary")
    road_class_mapping: dict[str, str] = field(
        default_factory=lambda: {"A": "motorway", "B": "primary", "L": "secondary", "K": "tertiary"}
    )
    line_assets: tuple[str, ...] = ("line", "cable", "minor_line")
    substation_assets: tuple[str, ...] = ("substation", "transformer")
    operating_status: str = "In Betrieb"
    display_technologies: tuple[str, ...] = ("Windenergie", "Photovoltaik Freifläche")
    station_source_key: str = "bnetza_ladesaeulenregister"
    station_source_name: str = "Bundesnetzagentur Ladesaeulenregister"


DEFAULT = RegionConfig()

# What the model calls itself and what its inputs assume.
FORMULA_VERSION = "nrw-2026.09.1"
FORMULA_VERSION_DATE = "2026-09-09"
SUPERSEDED_FORMULA_VERSION = "unversioned pre-S08 model"
FORMULA_NOTE = (
    "EV readiness density is charging points per km2 (was stations per km2); "
    "every composite is the weighted sum of its published one-decimal component "
    "scores; normalization bounds are published in analytics.nrw_score_model."
)
WIND_NOTE = (
    "Wind generation planning assumption; replace when reviewed direct generation data is available"
)
TRAFFIC_ASSUMPTIONS = {
    "traffic_measure_field": "DTVKFZA",
    "traffic_measure": "Average daily traffic volume, all motor vehicles, all days",
    "traffic_measure_unit": "vehicles per day",
    "traffic_network_scope": "Bundes-, Landes- and Kreisstrassen; Autobahn traffic is not part of this source",
    "traffic_source": "Strassen.NRW Verkehrswerte (Strassenverkehrszaehlung SVZ)",
    "traffic_source_documentation": (
        "Open Data - Datenbeschreibung Strassennetz Landesbetrieb Strassenbau NRW, 02.07.2025"
    ),
}
