"""Feature export in generations, a manifest over what was written, and promotion by pointer.

A generation is a folder of layers. Readers follow a one-row pointer table that is written last,
so a failed candidate leaves the served generation untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regionscore.config import DEFAULT, RegionConfig
from regionscore.functions.geojson import geometry_to_json
from regionscore.operators.quality import run_checks, violation
from regionscore.operators.quantiles import one_row
from regionscore.sources.inventory import file_digests
from regionscore.sources.splits import pieces
from regionscore.storage import path_exists

# The exported layers, their key, and what a district must carry.
EXPORTED = {
    "districts": "nuts_code",
    "chargers": "source_id",
    "autobahns": "source_id",
    "regional_roads": "source_id",
    "renewables": "source_id",
}
DISTRICT_REQUIRED = (
    "nuts_code", "district_name", "ev_readiness_score", "charger_deficit_score", "infrastructure_opportunity_score",
    "investment_priority_score", "data_quality_flag", "formula_version", "population_source_year",
    "transport_data_quality_flag", "grid_data_quality_flag", "energy_data_quality_flag",
    "operating_asset_renewable_capacity_mw", "municipal_workbook_renewable_capacity_mw",
)
ROWS_PER_FILE = 200_000


def feature_json(df: DataFrame, geom: str = "geom") -> Column:
    """One GeoJSON feature as text: every property, NULLs included, and the geometry."""
    properties = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != geom]), {"ignoreNullFields": "false"})
    geometry = F.coalesce(geometry_to_json(F.col(geom)), F.lit("null"))
    return F.concat(
        F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), geometry, F.lit("}")
    )


def export_features(df: DataFrame, key: str, path: str, *, geom: str = "geom", where: Column | None = None) -> None:
    """Write a layer as one feature per line, globally ordered by key, in files of bounded size."""
    rows = df if where is None else df.where(where)
    lines = rows.select(F.col(key).alias("__key"), feature_json(rows, geom).alias("value")).orderBy("__key")
    lines.select("value").write.option("maxRecordsPerFile", ROWS_PER_FILE).mode("errorifexists").text(path)


def collection_json(df: DataFrame, key: str, *, geom: str = "geom") -> DataFrame:
    """A small layer as one FeatureCollection document (district layers; features ordered by key)."""
    rows = df.select(F.struct(F.col(key).alias("k"), feature_json(df, geom).alias("f")).alias("r"))
    ordered = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["f"])
    return rows.agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", ordered), F.lit("]}")).alias("document")
    )


def content_hash(lines: Column) -> tuple[Column, Column]:
    """``(count, order-independent digest)`` of text rows as aggregates of fixed size.

    Each row's SHA-256 is cut into four numbers that are summed, so equal multisets of rows give
    the same digest however they are spread, and no task ever holds more than the sums.
    """
    digest = F.sha2(lines, 256)
    sums = [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)") for i in range(4)
    ]
    return F.count("*"), F.sha2(F.concat_ws(":", *[F.coalesce(s, F.lit(0)).cast("string") for s in sums]), 256)


def layer_record(df: DataFrame, name: str, *, geom: str = "geom") -> DataFrame:
    count, digest = content_hash(feature_json(df, geom))
    return df.agg(F.lit(name).alias("layer"), count.alias("features"), digest.alias("content_sha256"))


def build_manifest(layers: Mapping[str, DataFrame], *, geom: str = "geom") -> DataFrame:
    """One row per layer: how many features it has and the digest of its content."""
    table = None
    for name, df in layers.items():
        row = layer_record(df, name, geom=geom)
        table = row if table is None else table.union(row)
    return table


def payload_hash(manifest: DataFrame) -> DataFrame:
    """One digest over all layers of a manifest (a handful of rows)."""
    entries = F.array_sort(F.collect_list(F.concat_ws("=", "layer", "content_sha256")))
    return manifest.agg(F.sha2(F.concat_ws("\n", entries), 256).alias("snapshot_payload_sha256"))


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and digests of the part files of an exported generation."""
    return file_digests(spark, path).where(F.col("path").rlike(r"part-[^/]*\.txt$")).withColumn(
        "layer", F.regexp_extract("path", r"([^/]+)/part-[^/]*$", 1)
    )


def read_exported(spark: SparkSession, path: str) -> DataFrame:
    """Exported lines of a layer with the parsed feature parts."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    parsed = F.from_json("line", "type string, properties string, geometry struct<type string, coordinates string>")
    return lines.select("line", parsed.alias("f")).select("line", "f.type", "f.properties", "f.geometry")


def verify_layer(
    exported: DataFrame, name: str, manifest: DataFrame, config: RegionConfig = DEFAULT, key: str | None = None
) -> DataFrame:
    """``(check, violations)`` of an exported layer read back against its manifest row."""
    key = key or EXPORTED[name]
    ident = F.get_json_object("properties", f"$.{key}")
    features = exported.withColumn("key", ident)
    broken = (F.col("type") != "Feature") | F.col("properties").isNull() | F.col("geometry.type").isNull()
    checks = [
        violation(f"{name}: features are well formed", features.where(F.coalesce(broken, F.lit(True)))),
        violation(f"{name}: identity is present", features.where(F.col("key").isNull())),
        violation(f"{name}: identity is unique", features.groupBy("key").count().where("count > 1")),
    ]
    if name == "districts":
        absent = F.lit(False)
        keys = F.json_object_keys("properties")
        for field in DISTRICT_REQUIRED:
            absent = absent | ~F.array_contains(keys, field)
        checks.append(violation("districts: required fields", features.where(absent)))
        checks.append(
            features.agg(
                F.lit("districts: expected number").alias("check"),
                F.abs(F.count("*") - config.expected_regions).alias("violations"),
            )
        )
    if name == "renewables":
        technology = F.get_json_object("properties", "$.technology")
        status = F.get_json_object("properties", "$.status")
        shown = technology.isin(*config.display_technologies) & (status == config.operating_status)
        checks.append(violation("renewables: display filter", features.where(~F.coalesce(shown, F.lit(False)))))
    count, digest = content_hash(F.col("line"))
    stated = one_row(
        manifest.where(F.col("layer") == name).agg(F.max("features").alias("n"), F.max("content_sha256").alias("h"))
    )
    actual = exported.agg(count.alias("n"), digest.alias("h"))
    differs = (F.col("n") != stated["n"]) | (F.col("h") != stated["h"])
    checks.append(violation(f"{name}: count and hash match the manifest", actual.where(F.coalesce(differs, F.lit(True)))))
    table = checks[0]
    for c in checks[1:]:
        table = table.union(c)
    return table


def check_order(spark: SparkSession, path: str, name: str, key: str) -> DataFrame:
    """Whether the lines of a written layer rise by key, from file to file as well.

    Lines are compared with the one before in their split, splits of all files in order by their first and last key.
    """
    ident = F.get_json_object(F.col("raw").cast("string"), f"$.properties.{key}")
    lines = pieces(spark, path, "\n").select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), "block", "at", ident.alias("key"))
    inside = Window.partitionBy("file", "block").orderBy("at")
    falls = F.col("key") < F.lag("key").over(inside)
    splits = lines.withColumn("falls", falls).groupBy("file", "block").agg(
        F.count_if("falls").alias("falls"), F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last")
    )
    between = Window.partitionBy(F.lit(1)).orderBy("file", "block")  # a row for each split
    joined = splits.withColumn("step", F.coalesce(F.col("first") < F.lag("last").over(between), F.lit(False)))
    wrong = F.coalesce(F.sum("falls"), F.lit(0)) + F.count_if("step")
    return joined.agg(F.lit(f"{name}: features are in order").alias("check"), wrong.cast("bigint").alias("violations"))


def new_generation(root: str) -> tuple[str, str]:
    name = uuid.uuid4().hex
    return name, f"{root.rstrip('/')}/generations/{name}"


def promote(spark: SparkSession, root: str, generation: str) -> None:
    """Make a generation the served one: append the pointer row, written only after everything else."""
    row = spark.range(1).select(F.lit(generation).alias("generation"), F.current_timestamp().alias("promoted_at"))
    row.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/pointer")


def current_generation(spark: SparkSession, root: str) -> str | None:
    pointer = f"{root.rstrip('/')}/pointer"
    if not path_exists(spark, pointer):
        return None
    row = spark.read.parquet(pointer).agg(F.max_by("generation", "promoted_at").alias("g")).first()
    return row["g"]


def export_snapshot(
    spark: SparkSession,
    root: str,
    layers: Mapping[str, DataFrame],
    config: RegionConfig = DEFAULT,
    *,
    keys: Mapping[str, str] = EXPORTED,
) -> DataFrame:
    """Write all layers as one generation, check them as read back, then promote.

    A check that fails raises before the pointer moves. Returns the manifest.
    """
    name, folder = new_generation(root)
    for layer, df in layers.items():
        export_features(df, keys[layer], f"{folder}/{layer}")
    manifest_path = f"{folder}/manifest"
    build_manifest(layers).write.parquet(manifest_path)
    manifest = spark.read.parquet(manifest_path)
    checks = [verify_layer(read_exported(spark, f"{folder}/{layer}"), layer, manifest, config, keys[layer]) for layer in layers]
    run_checks([*checks, *[check_order(spark, f"{folder}/{layer}", layer, keys[layer]) for layer in layers]], strict=True)
    promote(spark, root, name)
    return manifest
