"""GeoJSON feature readers and the row mappers on top of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.config import DEFAULT, RegionConfig
from regionscore.functions.geojson import geojson_is_valid, geometry_from_json
from regionscore.functions.parsing import first_text, iso_date, traffic_observation, valid_position_json
from regionscore.operators.relational import split_valid
from regionscore.sources.splits import collection_features

_GEOMETRY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType()),
    ]
)


def feature_schema(properties: Sequence[str]) -> T.StructType:
    props = T.StructType([T.StructField(p, T.StringType()) for p in properties])
    return T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("id", T.StringType()),
            T.StructField("properties", props),
            T.StructField("geometry", _GEOMETRY),
        ]
    )


def read_feature_collection(
    spark: SparkSession, path: str, properties: Sequence[str], *, lines: bool = False
) -> DataFrame:
    """One row per feature: ``type, id, properties<strings>, geometry<type, raw coordinates>``.

    ``lines`` reads one feature per line. A single document is read by as many tasks as it has splits,
    however its lines are broken.
    """
    one = feature_schema(properties)
    if lines:
        return spark.read.schema(one).json(path)
    return collection_features(spark, path).select(F.from_json("feature", one).alias("f")).select("f.*")


def read_features(
    spark: SparkSession,
    path: str,
    *,
    id_keys: Sequence[str],
    properties: Sequence[str],
    kinds: Sequence[str],
    where: Column | None = None,
    lines: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` features with ``source_id``, the properties and ``geom``.

    ``id_keys`` are tried in order; the feature's own id is the key ``id``. Rejects say whether
    the id, the geometry or its kind is the problem.
    """
    wanted = list(dict.fromkeys([*properties, *[k for k in id_keys if k != "id"]]))
    raw = read_feature_collection(spark, path, wanted, lines=lines)
    flat = raw.select(
        first_text(*[F.col("id") if k == "id" else F.col(f"properties.`{k}`") for k in id_keys]).alias("source_id"),
        *[F.col(f"properties.`{p}`").alias(p) for p in properties],
        "geometry",
    )
    if where is not None:
        flat = flat.where(where)
    kind = F.col("geometry.type")
    rules = {
        "missing id": F.col("source_id").isNotNull(),
        "missing geometry": kind.isNotNull(),
        "wrong geometry type": kind.isin(*kinds),
        "invalid geometry": geojson_is_valid(kind, F.col("geometry.coordinates")),
    }
    accepted, rejected = split_valid(flat, rules)
    geom = geometry_from_json(kind, F.col("geometry.coordinates"))
    return accepted.withColumn("geom", geom).drop("geometry"), rejected.drop("geometry")


POLYGONS = ("Polygon", "MultiPolygon")
LINES = ("LineString", "MultiLineString")


def read_regions(spark: SparkSession, path: str, config: RegionConfig = DEFAULT, *, lines: bool = False) -> DataFrame:
    """District outlines of the configured prefix from a statistical-unit collection."""
    raw = read_feature_collection(spark, path, ["NUTS_ID", "NAME_LATN"], lines=lines)
    return raw.where(F.col("properties.NUTS_ID").startswith(config.region_prefix)).select(
        F.col("properties.NUTS_ID").alias("nuts_code"),
        F.lit(None).cast("string").alias("ags"),
        F.col("properties.NAME_LATN").alias("district_name"),
        F.lit(config.region_name).alias("region_name"),
        geometry_from_json(F.col("geometry.type"), F.col("geometry.coordinates")).alias("geom"),
    )


def region_rows(spark: SparkSession, path: str, *, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Districts from a collection whose properties go by any of the known names."""
    names = ["nuts_code", "NUTS_ID", "id", "ags", "district_name", "NAME_LATN", "name", "region", "region_name"]
    raw = read_feature_collection(spark, path, names, lines=lines)
    p = {n: F.col(f"properties.{n}") for n in names}
    kind = F.col("geometry.type")
    flat = raw.select(
        first_text(p["nuts_code"], p["NUTS_ID"], p["id"]).alias("nuts_code"),
        p["ags"].alias("ags"),
        first_text(p["district_name"], p["NAME_LATN"], p["name"]).alias("district_name"),
        first_text(p["region"], p["region_name"]).alias("region_name"),
        kind.alias("__kind"),
        geometry_from_json(kind, F.col("geometry.coordinates")).alias("geom"),
    )
    rules = {"missing nuts_code": F.col("nuts_code").isNotNull(), "wrong geometry type": F.col("__kind").isin(*POLYGONS)}
    accepted, rejected = split_valid(flat, rules)
    return accepted.drop("__kind"), rejected.drop("__kind", "geom")


def read_stations(spark: SparkSession, path: str, *, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stations from a point collection; coordinates must be two real numbers in range."""
    names = [
        "id", "source_id", "operator", "status", "charger_type", "charging_points", "power_kw", "max_point_power_kw",
        "street", "postcode", "city", "district_text", "state", "bundesland", "region",
    ]
    raw = read_feature_collection(spark, path, names, lines=lines)
    p = {n: F.col(f"properties.{n}") for n in names}
    coordinates = F.col("geometry.coordinates")
    position = F.from_json(coordinates, "array<double>")
    flat = raw.select(
        first_text(p["id"], p["source_id"]).alias("source_id"),
        *[p[n] for n in ("operator", "status", "charger_type")],
        p["charging_points"].try_cast("int").alias("charging_points"),
        p["power_kw"].try_cast("double").alias("power_kw"),
        p["max_point_power_kw"].try_cast("double").alias("max_point_power_kw"),
        *[p[n] for n in ("street", "postcode", "city", "district_text")],
        first_text(p["state"], p["bundesland"], p["region"]).alias("bundesland"),
        F.get(position, F.lit(0)).alias("lon"),
        F.get(position, F.lit(1)).alias("lat"),
        F.col("geometry.type").alias("__kind"),
        valid_position_json(coordinates).alias("__valid"),
    )
    rules = {
        "missing id": F.col("source_id").isNotNull(),
        "wrong geometry type": F.col("__kind") == "Point",
        "invalid coordinates": F.col("__valid"),
    }
    accepted, rejected = split_valid(flat, rules)
    return accepted.drop("__kind", "__valid"), rejected.drop("__kind", "__valid")


def snapshot_header(spark: SparkSession, path: str, config: RegionConfig = DEFAULT) -> DataFrame:
    """The publication date a document states at its head; no row when it states none."""
    head = spark.read.schema("snapshot_date string, source_key string, source_name string").json(path, multiLine=True)
    dated = head.where(F.col("snapshot_date").isNotNull()).select(
        first_text(F.col("source_key"), default=config.station_source_key).alias("source_key"),
        iso_date(F.col("snapshot_date")).alias("snapshot_date"),
        first_text(F.col("source_name"), default=config.station_source_name).alias("source_name"),
    )
    return dated.withColumn(
        "snapshot_date",
        F.when(F.col("snapshot_date").isNull(), F.raise_error(F.lit("invalid snapshot_date"))).otherwise(
            F.col("snapshot_date")
        ),
    )


GRID_ASSETS = (*DEFAULT.line_assets, *DEFAULT.substation_assets)


def read_grid(spark: SparkSession, path: str, *, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Power lines, cables, substations and transformers of an exported extract."""
    accepted, rejected = read_features(
        spark,
        path,
        id_keys=("id", "@id"),
        properties=("power", "voltage", "name"),
        kinds=("Point", "MultiPoint", *LINES, *POLYGONS),
        where=F.col("power").isin(*GRID_ASSETS),
        lines=lines,
    )
    return accepted.withColumnRenamed("power", "asset_type"), rejected


def read_motorways(spark: SparkSession, path: str, *, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    return read_features(
        spark,
        path,
        id_keys=("id", "@id"),
        properties=("highway", "ref", "name"),
        kinds=LINES,
        where=F.col("highway") == "motorway",
        lines=lines,
    )


# Which elements of an extract the two filters keep.
POWER_TAGS = {
    "way": {"power": ("line", "cable", "minor_line", "substation", "transformer")},
    "node": {"power": ("substation", "transformer")},
    "relation": {"power": ("substation", "transformer")},
}
MOTORWAY_TAGS = {"way": {"highway": ("motorway",)}}


def filter_tags(elements: DataFrame, wanted: dict[str, dict[str, Sequence[str]]]) -> DataFrame:
    """Elements ``(type, tags map)`` that carry a wanted tag for their type."""
    keep = F.lit(False)
    for kind, tags in wanted.items():
        for key, values in tags.items():
            keep = keep | ((F.col("type") == kind) & F.coalesce(F.try_element_at("tags", F.lit(key)).isin(*values), F.lit(False)))
    return elements.where(keep)


def prepare_roads(raw: DataFrame, *, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Counted road sections with their composite key and the published traffic rule applied.

    Strict mode makes an impossible reading fail the job; otherwise such rows are set aside.
    """
    names = ("DTVKFZA", "DTVKFZW", "DTVKFZU", "DTVKFZS")
    totals = {n: F.col(n) if n in raw.columns else F.lit(None).cast("double") for n in names}
    seen = traffic_observation(totals, F.col("DTVLVA"), F.col("DTVSVA"))
    keyed = raw.withColumns(
        {
            "osm_id": F.concat_ws(
                "|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("ABS", "ZSTNR", "VSTAT", "BSTAT")]
            ),
            "__t": seen,
        }
    )
    if strict:
        keyed = keyed.withColumn(
            "__t", F.when(F.col("__t.problem").isNotNull(), F.raise_error(F.col("__t.problem"))).otherwise(F.col("__t"))
        )
    rows = keyed.where(F.col("__t.problem").isNull()).select(
        "osm_id",
        F.col("STRKL").alias("road_class"),
        F.col("STRBEZ").alias("name"),
        F.col("STRNR").alias("road_number"),
        F.col("__t.total").alias("traffic_total"),
        F.col("__t.light").alias("traffic_light"),
        F.col("__t.heavy").alias("traffic_heavy"),
        F.col("ZSTART").alias("counting_station_type"),
        F.lit("Straßen.NRW Verkehrswerte").alias("source"),
        "geom",
    )
    rejected = keyed.where(F.col("__t.problem").isNotNull()).select("osm_id", F.col("__t.problem").alias("reason"))
    return rows, rejected
