"""Tabular readers: population, plants, renewable layers, energy sheets, catalogs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionscore.config import DEFAULT
from regionscore.functions.parsing import district_key, finite_or_null, first_text, pad_ags
from regionscore.operators.quality import population_problems, unique_or_raise
from regionscore.operators.relational import last_by_order
from regionscore.operators.rollups import CAPACITY_SUFFIX, YIELD_SUFFIX, sum_known, sum_yield
from regionscore.sources.splits import header_of, read_csv

POPULATION_SOURCE = "Eurostat demo_r_pjanaggr3"
ENERGY_SOURCE = "LANUK NRW Energieatlas"
STORAGE_PREFIX = "Speicher:"


def read_population(spark: SparkSession, path: str, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, problems)`` of a population snapshot checked against the expected districts."""
    record = (
        "struct<district_code: string, nuts_code: string, ags: string, population: string, "
        "reference_year: string, source: string>"
    )
    documents = spark.read.schema(f"records array<{record}>").json(path, multiLine=True)

    def whole(name: str) -> Column:
        """An integer written as one; a fraction or text is not a count."""
        return F.when(F.col(name).rlike(r"^-?[0-9]+\z"), F.col(name).try_cast("int"))

    rows = documents.select(F.inline("records")).select(
        first_text(F.col("district_code"), F.col("nuts_code")).alias("district_code"),
        F.coalesce("nuts_code", F.lit("")).alias("nuts_code"),
        "ags",
        whole("population").alias("population"),
        whole("reference_year").alias("reference_year"),
        first_text(F.col("source"), default=POPULATION_SOURCE).alias("source"),
    )
    return rows, population_problems(rows, expected)


def latest_observation(documents: DataFrame) -> DataFrame:
    """``(code, year, value)``: the latest year that has a value, per statistics document.

    ``documents`` is ``(code, index map<year, position>, value map<position, value>)``.
    """
    points = documents.select("code", "value", F.explode("index").alias("year", "position")).select(
        "code",
        F.col("year").cast("int").alias("year"),
        F.try_element_at("value", F.col("position").cast("string")).cast("bigint").alias("found"),
    )
    known = points.where(F.col("found").isNotNull())
    return known.groupBy("code").agg(F.max("year").alias("year"), F.max_by("found", "year").alias("value"))


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded statistics documents, one per file, in the shape :func:`latest_observation` takes."""
    schema = (
        "dimension struct<geo: struct<category: struct<index: map<string,int>>>, "
        "time: struct<category: struct<index: map<string,int>>>>, value map<string,bigint>"
    )
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select(
        F.get(F.map_keys("dimension.geo.category.index"), F.lit(0)).alias("code"),
        F.col("dimension.time.category.index").alias("index"),
        "value",
    )


def read_plants(spark: SparkSession, path: str, state: str = DEFAULT.region_name) -> DataFrame:
    """Power plants of a state that have an id and a position."""
    raw = read_csv(spark, path, header_of(spark, path))
    return raw.where(
        (F.col("state") == state) & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("id").isNotNull()
    ).select(
        F.col("id").alias("source_id"),
        F.col("name_bnetza").alias("name"),
        F.col("company").alias("operator"),
        "energy_source",
        "technology",
        F.col("capacity_net_bnetza").try_cast("double").alias("capacity_mw"),
        "status",
        "voltage",
        "network_operator",
        F.col("lon").cast("double").alias("lon"),
        F.col("lat").cast("double").alias("lat"),
    )


def union_layers(layers: Mapping[str, DataFrame]) -> DataFrame:
    """Renewable sites of every layer; the layer name becomes the technology and part of the id."""
    table = None
    for name, frame in layers.items():
        def column(source: str, frame: DataFrame = frame) -> Column:
            return F.col(f"`{source}`") if source in frame.columns else F.lit(None).cast("string")

        capacity = column("Bruttoleistung el. [kW]").cast("double")
        rows = frame.select(
            F.concat_ws("|", F.lit(name), column("Einheitennummer").cast("string")).alias("source_id"),
            column("Name der Einheit").alias("name"),
            column("Anlagenbetreiber").alias("operator"),
            column("Energieträger").alias("asset_type"),
            F.lit(name).alias("technology"),
            F.when(~F.isnan(capacity), capacity / 1000.0).alias("capacity_mw"),
            column("Status").alias("status"),
            *[F.col(c) for c in ("lon", "lat")],
        )
        table = rows if table is None else table.unionByName(rows)
    return table


def read_renewable_layers(spark: SparkSession, layers: Mapping[str, str]) -> DataFrame:
    return unique_or_raise(
        union_layers({name: spark.read.parquet(path) for name, path in layers.items()}), ["source_id"], "renewable site"
    )


def district_lookup(districts: DataFrame) -> DataFrame:
    """``(key, nuts_code)`` by normalized name; an empty or ambiguous name is an error."""
    keyed = districts.select(district_key(F.col("district_name")).alias("key"), "nuts_code").distinct()
    problem = (
        keyed.groupBy("key").agg(F.count("*").alias("n")).where((F.col("key") == "") | (F.col("n") > 1)).limit(1).collect()
    )
    if problem:
        raise ValueError(f"missing or ambiguous district name: {problem[0]['key']!r}")
    return keyed


def unmapped_districts(sheet: DataFrame, lookup: DataFrame) -> DataFrame:
    keyed = sheet.select("Kreis", district_key(F.col("Kreis")).alias("key")).distinct()
    return keyed.join(lookup, "key", "left_anti").select("Kreis")


def _checked_sheet(sheet: DataFrame, label: str, required: Sequence[str], lookup: DataFrame) -> DataFrame:
    """A sheet with typed keys and the district code; structural problems are errors."""
    absent = sorted({"Jahr", "Gemeinde", "Kreis", "AGS", *required} - set(sheet.columns))
    if absent:
        raise ValueError(f"{label} is missing required columns: {', '.join(absent)}")
    facts = sheet.agg(
        F.count("*").alias("n"), F.count_if(F.col("Jahr").isNull() | F.col("AGS").isNull()).alias("unkeyed")
    ).first()
    if not facts["n"]:
        raise ValueError(f"{label} snapshot is empty")
    if facts["unkeyed"]:
        raise ValueError(f"{label} contains a missing year or AGS")
    unique_or_raise(sheet, ["Jahr", "AGS"], label)
    unmapped = unmapped_districts(sheet, lookup).limit(1).collect()
    if unmapped:
        raise ValueError(f"unmapped district: {unmapped[0]['Kreis']}")
    keyed = sheet.withColumns(
        {"year": F.col("Jahr").cast("int"), "ags": pad_ags(F.col("AGS")), "key": district_key(F.col("Kreis"))}
    )
    return keyed.join(lookup, "key").drop("key")


def _reading(name: str, columns: Sequence[str]) -> Column:
    """A finite reading, unknown when empty; a non-finite one fails the load."""
    if name not in columns:
        return F.lit(None).cast("double")
    value = F.col(f"`{name}`").cast("double")
    missing = value.isNull() | F.isnan(value)
    return F.when(
        ~missing & finite_or_null(value).isNull(), F.raise_error(F.lit(f"{name} must be finite")).cast("double")
    ).when(~missing, value)


def technology_columns(columns: Sequence[str], suffix: str) -> list[str]:
    return [c for c in columns if c.endswith(suffix) and not c.startswith(STORAGE_PREFIX)]


def _with_finite(sheet: DataFrame, names: Sequence[str]) -> DataFrame:
    return sheet.withColumns({n: _reading(n, sheet.columns) for n in names})


def prepare_energy(
    consumption: DataFrame, stock: DataFrame, growth: DataFrame, districts: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(consumption rows, renewable rows, reporting year)`` of the three workbook sheets.

    Technology columns are found by their suffix. A municipality known to only one of the
    renewable sheets keeps what that sheet knows.
    """
    lookup = district_lookup(districts)
    used = _checked_sheet(consumption, "consumption", ["Stromverbrauch (GWh)"], lookup)
    held = _checked_sheet(stock, "renewable stock", [], lookup)
    added = _checked_sheet(growth, "renewable growth", [], lookup)

    total = _reading("Stromverbrauch (GWh)", used.columns)
    checked = (
        F.when(total.isNull(), F.raise_error(F.lit("Stromverbrauch (GWh) is missing")).cast("double"))
        .when(total < 0, F.raise_error(F.lit("Stromverbrauch (GWh) cannot be negative")).cast("double"))
        .otherwise(total)
    )
    consumption_rows = used.select(
        "year",
        F.col("Gemeinde").cast("string").alias("municipality_name"),
        F.col("Kreis").cast("string").alias("district_name"),
        "nuts_code",
        "ags",
        checked.alias("consumption_gwh"),
        _reading("Stromverbrauch Industrie (GWh)", used.columns).alias("industry_gwh"),
        _reading("Stromverbrauch GHD (GWh)", used.columns).alias("commerce_services_gwh"),
        _reading("Stromverbrauch Haushalte (GWh)", used.columns).alias("households_gwh"),
        F.lit(ENERGY_SOURCE).alias("source"),
    )

    yields = technology_columns(held.columns, YIELD_SUFFIX)
    capacities = technology_columns(held.columns, CAPACITY_SUFFIX)
    additions = technology_columns(added.columns, CAPACITY_SUFFIX)
    if not yields or "Wind: Leistung (MW)" not in capacities:
        raise ValueError("renewable stock does not contain yields and wind capacity")
    if not additions:
        raise ValueError("renewable growth does not contain renewable capacities")
    held, added = _with_finite(held, yields + capacities), _with_finite(added, additions)
    generation, unknown = sum_yield(held, yields)
    identity = ("Gemeinde", "Kreis", "nuts_code")
    left = held.select(
        "year", "ags", *[F.col(c).cast("string").alias(f"s_{c}") for c in identity], F.lit(True).alias("in_stock"),
        generation.alias("published_generation_mwh"), unknown.alias("unknown"),
        F.col("`Wind: Leistung (MW)`").alias("wind_capacity_mw"),
        sum_known(held, capacities).alias("renewable_capacity_mw"),
    )
    right = added.select(
        "year", "ags", *[F.col(c).cast("string").alias(f"g_{c}") for c in identity],
        sum_known(added, additions).alias("renewable_net_addition_mw"),
    )

    def either(name: str) -> Column:
        return F.when(F.col("in_stock"), F.col(f"s_{name}")).otherwise(F.col(f"g_{name}"))

    renewable_rows = left.join(right, ["year", "ags"], "full_outer").select(
        "year",
        either("Gemeinde").alias("municipality_name"),
        either("Kreis").alias("district_name"),
        either("nuts_code").alias("nuts_code"),
        "ags",
        "published_generation_mwh",
        F.coalesce("unknown", F.lit(0)).alias("generation_components_unknown"),
        "wind_capacity_mw",
        "renewable_capacity_mw",
        "renewable_net_addition_mw",
        F.lit(ENERGY_SOURCE).alias("source"),
    )
    year = (
        used.select("year").distinct().join(held.select("year").distinct(), "year").agg(F.max("year").alias("reporting_year"))
    )
    year = year.select(
        F.when(
            F.col("reporting_year").isNull(),
            F.raise_error(F.lit("consumption and renewable stock have no common reporting year")).cast("int"),
        )
        .otherwise(F.col("reporting_year"))
        .alias("reporting_year")
    )
    return consumption_rows, renewable_rows, year


def read_catalogs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Source catalogs merged by dataset id; where both name one, the later catalog wins whole."""
    merged = None
    for order, path in enumerate(paths):
        table = read_csv(spark, path, header_of(spark, path)).drop("ordinal").withColumn("catalog_order", F.lit(order))
        merged = table if merged is None else merged.unionByName(table, allowMissingColumns=True)
    return last_by_order(merged, "dataset_id", "catalog_order").drop("catalog_order")


def select_sources(
    catalog: DataFrame, *, ids: DataFrame | None = None, include_large: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """``(sources to fetch, requested ids the catalog does not know)``."""
    unknown = None
    if ids is not None:
        unknown = ids.join(catalog, "dataset_id", "left_anti").select("dataset_id")
        catalog = catalog.join(ids.select("dataset_id").distinct(), "dataset_id", "left_semi")
    access = ["public", "public_large"] if include_large else ["public"]
    return catalog.where(F.col("access_type").isin(*access)), unknown
