"""Runs, their inputs, source dates and the lineage of published layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionscore.functions.parsing import is_sha256

# Catalog ids whose ingest records go by another key, and what scores draw on.
INGEST_KEYS = {"bnetza_charging_register_nrw": "bnetza_ladesaeulenregister"}
_SCORING = (
    "nuts3_regions_gisco_nrw",
    "bnetza_charging_register_nrw",
    "eurostat_population_nrw",
    "strassen_nrw_traffic_values",
    "energieatlas_nrw_renewable_sites",
    "energieatlas_nrw_admin_electricity",
    "geofabrik_nrw_osm_power",
)
LAYER_SOURCES = {
    "nrw_accessibility": ("strassen_nrw_traffic_values",),
    "nrw_autobahns": ("geofabrik_nrw_osm_power",),
    "nrw_chargers": ("bnetza_charging_register_nrw",),
    "nrw_district_priority": _SCORING,
    "nrw_ev_baseline_metrics": _SCORING,
    "nrw_ev_scenario_metrics": _SCORING,
    "nrw_grid_absorption_risk": _SCORING,
    "nrw_grid_proxy": ("nuts3_regions_gisco_nrw", "geofabrik_nrw_osm_power"),
    "nrw_grid_readiness": ("geofabrik_nrw_osm_power",),
    "nrw_infrastructure_opportunity": _SCORING,
    "nrw_local_energy_balance": (
        "nuts3_regions_gisco_nrw", "energieatlas_nrw_renewable_sites", "energieatlas_nrw_admin_electricity",
    ),
    "nrw_renewable_context": ("nuts3_regions_gisco_nrw", "energieatlas_nrw_renewable_sites"),
    "nrw_renewable_potential": ("energieatlas_nrw_renewable_sites",),
    "nrw_regional_roads": ("strassen_nrw_traffic_values",),
    "nrw_transport_load": ("nuts3_regions_gisco_nrw", "strassen_nrw_traffic_values"),
    "proposed_chargers": (),
}


def record_run(runs: DataFrame, run_id: str, at: Column | None = None) -> DataFrame:
    """The run log with one more run; which run is current is derived, never stored."""
    row = runs.sparkSession.range(1).select(
        F.lit(run_id).alias("ingest_run_id"), (at if at is not None else F.current_timestamp()).alias("recorded_at")
    )
    return runs.select("ingest_run_id", "recorded_at").unionByName(row)


def _current_id(runs: DataFrame) -> Column:
    """Id of the latest run (the greatest id among equals) as a scalar."""
    order = F.struct("recorded_at", "ingest_run_id")
    return runs.agg(F.max_by("ingest_run_id", order).alias("ingest_run_id")).scalar()


def with_current(runs: DataFrame) -> DataFrame:
    """Runs with ``is_current``: exactly the latest one."""
    return runs.withColumn("is_current", F.col("ingest_run_id") == _current_id(runs))


def bind_inputs(inventory: DataFrame, run_id: str) -> DataFrame:
    return inventory.select(F.lit(run_id).alias("ingest_run_id"), *inventory.columns)


def current_inputs(runs: DataFrame, inputs: DataFrame) -> DataFrame:
    return inputs.where(F.col("ingest_run_id") == _current_id(runs))


def set_source_date(snapshots: DataFrame, key: str, row: DataFrame) -> DataFrame:
    """Replace a source's date; a load that states none clears the old one."""
    return snapshots.where(F.col("source_key") != key).unionByName(row)


def publish_metadata(model: DataFrame, snapshots: DataFrame, runs: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row of ordered JSON lists: score model, source dates, the current run and its inputs."""

    def listed(df: DataFrame, order: str, name: str) -> DataFrame:
        entry = F.struct(F.col(order).alias("o"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
        rows = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["j"])
        return df.agg(F.concat(F.lit("["), F.concat_ws(",", rows), F.lit("]")).alias(name))

    run = with_current(runs).where("is_current").agg(F.max("ingest_run_id").alias("ingest_run_id"))
    spark = model.sparkSession
    parts = [
        (listed(model, "sort_order", "score_model"), "score_model"),
        (listed(snapshots, "source_key", "source_snapshots"), "source_snapshots"),
        (run, "ingest_run_id"),
        (listed(current_inputs(runs, inputs).drop("ingest_run_id"), "source_key", "ingested_source_provenance"),
         "ingested_source_provenance"),
    ]
    return spark.range(1).select(*[table.select(name).scalar().alias(name) for table, name in parts])


def provenance_problems(runs: DataFrame, inputs: DataFrame) -> DataFrame:
    """``(check, violations)`` of the provenance a published snapshot must carry."""
    rows = current_inputs(runs, inputs)
    text = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    sound = (
        text(F.col("source_key"))
        & text(F.col("source_path"))
        & F.coalesce(F.col("bytes") >= 0, F.lit(False))
        & is_sha256(F.col("sha256"))
    )
    current = with_current(runs).agg(
        F.lit("exactly one current run").alias("check"), F.abs(F.count_if("is_current") - 1).alias("violations")
    )
    some = rows.agg(
        F.lit("current run has inputs").alias("check"),
        F.when(F.count("*") == 0, 1).otherwise(0).cast("bigint").alias("violations"),
    )
    broken = rows.agg(F.lit("input records are well formed").alias("check"), F.count_if(~sound).alias("violations"))
    return current.union(some).union(broken)


def layer_table(spark, layers: dict[str, tuple[str, ...]] = LAYER_SOURCES) -> DataFrame:
    """``(layer, position, source_id)``, one row per layer and source."""
    rows = [(layer, i, source) for layer, sources in layers.items() for i, source in enumerate(sources)]
    return spark.createDataFrame(rows, "layer string, position int, source_id string")


def layer_lineage(layers: DataFrame, catalog: DataFrame, inputs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every layer's sources with address, terms, role, ingest state, date and digest.

    Only inputs bound to the current run count as evidence; without one the row says so and
    carries nothing but the catalog's own statements.
    """
    key = F.col("source_id")
    for catalog_id, ingest in INGEST_KEYS.items():
        key = F.when(F.col("source_id") == catalog_id, ingest).otherwise(key)

    def from_catalog(*names: str) -> list[Column]:
        return [F.nullif(F.col(f"c.{n}"), F.lit("")) for n in names if n in catalog.columns]

    def upstream(field: str) -> Column:
        return F.nullif(F.get_json_object("i.provenance", f"$.{field}"), F.lit(""))

    recorded = F.col("i.source_key").isNotNull()
    joined = (
        layers.withColumn("ingest_key", key)
        .alias("l")
        .join(catalog.alias("c"), F.col("l.source_id") == F.col("c.dataset_id"))
        .join(inputs.alias("i"), F.col("l.ingest_key") == F.col("i.source_key"), "left")
        .join(snapshots.alias("s"), F.col("l.ingest_key") == F.col("s.source_key"), "left")
    )
    terms = F.coalesce(*from_catalog("licence", "license_note"), F.lit("Terms not recorded in the source catalogue"))
    has_upstream = F.coalesce(F.size(F.json_object_keys("i.provenance")) > 0, F.lit(False))
    return joined.select(
        "l.layer",
        "l.position",
        F.col("l.source_id").alias("id"),
        F.coalesce(F.when(recorded, upstream("url")), *from_catalog("source_url", "url")).alias("source_url"),
        F.coalesce(F.when(recorded, upstream("licence")), terms).alias("terms"),
        F.col("c.source_role").alias("role"),
        F.when(~recorded, "not recorded in current successful ingest")
        .when(has_upstream, "recorded")
        .otherwise("recorded without upstream sidecar")
        .alias("ingest_status"),
        F.when(recorded, F.coalesce(upstream("source_date"), F.col("s.snapshot_date").cast("string"))).alias("source_date"),
        F.when(recorded, F.col("s.source_note")).alias("source_date_evidence"),
        F.when(recorded, F.col("s.recorded_at")).alias("snapshot_recorded_at"),
        F.when(recorded, upstream("accessed_at")).alias("accessed_at"),
        F.when(recorded, F.col("i.sha256")).alias("sha256"),
    )
