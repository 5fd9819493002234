"""The whole refresh: read and validate everything, measure, score, check, publish, then promote."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionscore.config import DEFAULT, RegionConfig
from regionscore.operators.quality import duplicate_keys, run_checks, snapshot_guard, violation
from regionscore.operators.relational import blank_to_null
from regionscore.operators.scoring import score_model
from regionscore.operators.validity import geometry_report
from regionscore.plans import energy as E
from regionscore.plans import measures as M
from regionscore.plans import publish as P
from regionscore.plans import scenario as SC
from regionscore.plans import scores as S
from regionscore.plans import verify as V
from regionscore.schemas import PROPOSALS, PUBLISHED
from regionscore.sinks.export import current_generation, export_snapshot, new_generation, promote
from regionscore.sinks.layers import read_layer, write_layer
from regionscore.storage import materialize, path_exists


@dataclass(frozen=True)
class Inputs:
    """Raw tables of one refresh, in the layouts of :mod:`regionscore.schemas`."""

    districts: DataFrame
    stations: DataFrame
    population: DataFrame
    roads: DataFrame
    grid: DataFrame
    renewables: DataFrame
    consumption: DataFrame
    renewable_balance: DataFrame
    snapshots: DataFrame
    motorways: DataFrame | None = None
    proposals: DataFrame | None = None


@dataclass
class Analytics:
    """Everything a refresh derives, as stored district tables."""

    inputs: Inputs
    districts: M.Districts
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


STATION_TEXT = (
    "operator", "status", "charger_type", "street", "postcode", "city", "district_text", "bundesland",
)


def validate_inputs(inputs: Inputs, config: RegionConfig = DEFAULT) -> DataFrame:
    """Checks that must hold before anything is replaced."""
    checks = [
        snapshot_guard(inputs.districts, inputs.stations, config),
        violation("district keys are unique", duplicate_keys(inputs.districts, ["nuts_code"])),
        violation("station keys are unique", duplicate_keys(inputs.stations, ["source_id"])),
        violation("road keys are unique", duplicate_keys(inputs.roads, ["osm_id"])),
        violation("grid keys are unique", duplicate_keys(inputs.grid, ["source_id"])),
        violation("renewable keys are unique", duplicate_keys(inputs.renewables, ["source_id"])),
        violation("consumption keys are unique", duplicate_keys(inputs.consumption, ["year", "ags"])),
        violation("renewable balance keys are unique", duplicate_keys(inputs.renewable_balance, ["year", "ags"])),
        violation("district outlines are valid", geometry_report(inputs.districts)),
    ]
    return run_checks(checks)


def analyse(inputs: Inputs, config: RegionConfig = DEFAULT, *, cell: float | None = None) -> Analytics:
    """Measure once, score on top; both are stored because every later step reads them."""
    districts = M.prepare_districts(inputs.districts, config)
    result = Analytics(inputs, districts)
    t = result.tables
    t["district_metrics"] = materialize(
        M.district_metrics(districts, inputs.stations, inputs.population, cell=cell), "district_metrics"
    )
    t["transport_raw"] = materialize(M.transport_raw(districts, inputs.roads, cell=cell), "transport_raw")
    t["grid_raw"] = materialize(M.grid_raw(districts, inputs.grid, config, cell=cell), "grid_raw")
    t["renewable_raw"] = materialize(M.renewable_raw(districts, inputs.renewables, config), "renewable_raw")
    t["energy_raw"] = materialize(
        E.energy_balance_raw(districts.table, inputs.consumption, inputs.renewable_balance, config), "energy_raw"
    )
    t["transport_bounds"] = S.transport_bounds(t["transport_raw"])
    t["grid_bounds"] = S.grid_bounds(t["grid_raw"])
    t["renewable_bounds"] = S.renewable_bounds(t["renewable_raw"])
    t["energy_bounds"] = S.energy_bounds(t["energy_raw"])
    # District tables are read by several later steps; each is stored once instead of planned again.
    t["transport"] = materialize(S.transport_metrics(t["transport_raw"], t["transport_bounds"]), "transport")
    t["grid"] = materialize(S.grid_metrics(t["grid_raw"], t["grid_bounds"]), "grid")
    t["renewable"] = materialize(S.renewable_metrics(t["renewable_raw"], t["renewable_bounds"]), "renewable")
    t["energy"] = materialize(E.local_energy_balance(t["energy_raw"], t["energy_bounds"], t["grid"]), "energy")
    t["opportunity"] = materialize(
        S.infrastructure_opportunity(t["district_metrics"], t["transport"], t["grid"], t["renewable"]), "opportunity"
    )
    t["ev_raw"] = S.ev_measures(t["district_metrics"])
    t["ev_bounds"] = S.ev_bounds(t["ev_raw"])
    t["ev_scored"] = S.ev_scores(t["ev_raw"], t["ev_bounds"], t["opportunity"])
    t["baseline"] = materialize(
        S.ev_baseline(
            t["ev_scored"], t["transport"], t["grid"], t["renewable"], t["energy"], t["opportunity"], inputs.snapshots,
            config,
        ),
        "baseline",
    )
    t["score_model"] = score_model(
        districts.table.sparkSession,
        t["ev_bounds"],
        t["transport_bounds"],
        t["grid_bounds"],
        t["renewable_bounds"],
        t["energy_bounds"],
    )
    return result


def scenario(result: Analytics, *, cell: float | None = None) -> DataFrame:
    """Baseline and scenario side by side, computed once; without proposals they are equal."""
    t, proposals = result.tables, result.inputs.proposals
    if "scenario" not in t:
        if proposals is None:
            proposals = result.districts.table.sparkSession.createDataFrame([], PROPOSALS)
        measures = SC.scenario_measures(result.districts, t["district_metrics"], proposals, cell=cell)
        t["scenario"] = materialize(SC.scenario_compare(measures, t["baseline"], t["ev_bounds"], t["opportunity"]), "scenario")
    return t["scenario"]


# One row for each region: measured, scored and published.
COUNTED_TABLES = ("transport_raw", "transport", "grid_raw", "grid", "renewable_raw", "renewable", "opportunity", "baseline", "energy", "scenario")
COUNTED_LAYERS = ("transport_load", "grid_proxy", "renewable_context", "infrastructure_opportunity", "ev_baseline_metrics", "ev_scenario_metrics", "district_priority")
AREAS, ROUTES = ("Polygon", "MultiPolygon"), ("LineString", "MultiLineString")
# What the geometry of each layer must be; district layers have outlines.
LAYER_KINDS = {
    "chargers": ("Point",),
    "grid_readiness": ("Point", "MultiPoint", *ROUTES, *AREAS),
    "renewable_potential": ("Point",),
    "accessibility": ROUTES,
    "regional_roads": ROUTES,
    "autobahns": ROUTES,
}


def verify(result: Analytics, config: RegionConfig = DEFAULT, *, strict: bool = False) -> DataFrame:
    """All checks after a refresh as one ``(check, violations)`` table."""
    t, raw = result.tables, result.inputs
    baseline = t["baseline"]
    checks = [
        *[V.check_row_count(t[name], name, config.expected_regions) for name in COUNTED_TABLES if name in t],
        *([V.check_scenario(t["scenario"])] if "scenario" in t else []),
        V.check_station_semantics(raw.stations),
        V.check_station_totals(t["district_metrics"], M.station_owners(raw.stations, result.districts)),
        V.check_renewable_domain(t["renewable_raw"], t["renewable_bounds"]),
        V.check_score_model(t["score_model"]),
        V.check_model_recomputation(baseline, t["score_model"]),
        V.check_opportunity(t["opportunity"]),
        V.check_transport(t["transport"]),
        V.check_grid(t["grid"]),
        V.check_baseline(baseline),
        V.check_capacity_kept_apart(baseline, t["renewable"], t["energy"]),
        V.check_rank_ties(baseline),
        V.check_energy(t["energy"]),
        V.check_energy_reconciliation(t["energy"], raw.consumption, raw.renewable_balance, config),
        V.check_district_contract(baseline, config),
    ]
    return run_checks(checks, strict=strict)


def verify_layers(layers: dict[str, DataFrame], config: RegionConfig = DEFAULT, *, strict: bool = False) -> DataFrame:
    """The contract of published layers: required columns, geometry, positions, one row for each region, one priority definition."""
    checks = []
    for name, layer in layers.items():
        required = PUBLISHED.get(name, ("nuts_code", "geom") if "nuts_code" in layer.columns else ())
        checks.append(V.check_layer(layer, name, required, LAYER_KINDS.get(name, AREAS)))
        if name in COUNTED_LAYERS:
            checks.append(V.check_row_count(layer, f"published {name}", config.expected_regions))
    if "district_priority" in layers:
        same = set(layers["district_priority"].dtypes) <= set(layers["ev_baseline_metrics"].dtypes)
        checks.append(layers["district_priority"].sparkSession.range(1).select(F.lit("district_priority has no columns of its own").alias("check"), F.lit(0 if same else 1).cast("bigint").alias("violations")))
    return run_checks(checks, strict=strict)


def published_layers(result: Analytics, config: RegionConfig = DEFAULT) -> dict[str, DataFrame]:
    """The published layers by name, geometry attached last."""
    t, raw, districts = result.tables, result.inputs, result.districts
    layers = {
        "chargers": P.publish_chargers(raw.stations, districts),
        "grid_readiness": P.publish_grid_readiness(raw.grid, districts, config),
        "renewable_potential": P.publish_renewable_potential(raw.renewables, districts, config),
        "accessibility": P.publish_accessibility(raw.roads, districts, config),
        "regional_roads": P.publish_regional_roads(raw.roads, config),
        "transport_load": P.with_district_geometry(t["transport"], districts),
        "grid_proxy": P.with_district_geometry(t["grid"], districts),
        "renewable_context": P.with_district_geometry(t["renewable"], districts),
        "local_energy_balance": P.publish_local_energy_balance(t["energy"], districts),
        "grid_absorption_risk": P.publish_grid_absorption_risk(t["energy"], districts),
        "infrastructure_opportunity": P.with_district_geometry(t["opportunity"], districts),
        "ev_baseline_metrics": P.with_district_geometry(t["baseline"], districts),
        "ev_scenario_metrics": P.publish_scenario(scenario(result), districts),
        "district_priority": P.with_district_geometry(t["baseline"], districts),
        "score_model": t["score_model"],
        "traffic_assumptions": S.traffic_assumptions(districts.table.sparkSession),
    }
    if raw.motorways is not None:
        layers["autobahns"] = P.publish_autobahns(raw.motorways)
    return layers


def refresh(
    spark: SparkSession, inputs: Inputs, root: str, config: RegionConfig = DEFAULT, *, cell: float | None = None
) -> Analytics:
    """Validate, measure, check and publish; the pointer moves only after every check passed."""
    run_checks([validate_inputs(inputs, config)], strict=True)
    cleaned = Inputs(
        **{
            **inputs.__dict__,
            "stations": blank_to_null(inputs.stations, [c for c in STATION_TEXT if c in inputs.stations.columns]),
            "grid": blank_to_null(inputs.grid, ["voltage", "name"]),
            "districts": blank_to_null(inputs.districts, ["ags", "district_name", "region_name"]),
        }
    )
    result = analyse(cleaned, config, cell=cell)
    scenario(result, cell=cell)
    verify(result, config, strict=True)
    name, folder = new_generation(root)
    layers = published_layers(result, config)
    for layer, df in layers.items():
        write_layer(df, f"{folder}/{layer}")
    # checked as written, before the pointer moves
    verify_layers({layer: read_layer(spark, f"{folder}/{layer}") for layer in layers}, config, strict=True)
    promote(spark, root, name)
    return result


def exported_layers(spark: SparkSession, root: str, config: RegionConfig = DEFAULT) -> dict[str, DataFrame]:
    """The layers of the served generation that the map export takes, all from one generation."""
    folder = f"{root.rstrip('/')}/generations/{current_generation(spark, root)}"
    names = {
        "districts": "ev_baseline_metrics",
        "chargers": "chargers",
        "autobahns": "autobahns",
        "regional_roads": "regional_roads",
        "renewables": "renewable_potential",
    }
    present = {layer: f"{folder}/{name}" for layer, name in names.items() if path_exists(spark, f"{folder}/{name}")}
    layers = {layer: read_layer(spark, path) for layer, path in present.items()}
    if "renewables" in layers:
        layers["renewables"] = P.displayed_renewables(layers["renewables"], config)
    return layers


def export(spark: SparkSession, root: str, target: str, config: RegionConfig = DEFAULT) -> DataFrame:
    """Export the served generation for the map; returns the manifest of what was promoted."""
    return export_snapshot(spark, target, exported_layers(spark, root, config), config)
