"""Accept/reject classification, key checks and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionscore.config import DEFAULT, RegionConfig
from regionscore.functions.parsing import valid_coordinates
from regionscore.operators.region_index import RegionIndex
from regionscore.operators.relational import flag_first, key_differences
from regionscore.operators.spatial import region_matches

# The reject record and its reasons.
EXCEPTION_FIELDS = ("id", "name", "operator", "district_text", "longitude", "latitude", "reason")
ALLOWED_REASONS = ("invalid_coordinates", "outside_nrw", "duplicate_id")


def missing_ids(df: DataFrame, ident: str) -> DataFrame:
    return df.where(F.coalesce(F.trim(F.col(ident).cast("string")), F.lit("")) == "")


def classify_points(
    df: DataFrame,
    index: RegionIndex,
    *,
    ident: str = "id",
    ordinal: str = "ordinal",
    lon: str = "lon",
    lat: str = "lat",
    region_id: str = "nuts_code",
) -> DataFrame:
    """Every record with its region or the one reason it is rejected, nothing lost.

    A repeat is a duplicate whatever its coordinates, and the first record owns the id even when
    its own coordinates are bad. A record without an id is an error of the source.
    """
    if missing_ids(df, ident).limit(1).count():
        raise ValueError("a record is missing its id")
    flagged = flag_first(df, ident, ordinal, "__first").withColumn(
        "__valid", valid_coordinates(F.col(lon), F.col(lat))
    )
    # Only first records with a position are looked up; the others pass through unmatched.
    looked_up = region_matches(flagged, index, ident, x=lon, y=lat, keep_where=F.col("__first") & F.col("__valid"))
    placed = looked_up.withColumn("__region", F.get("regions", F.lit(0))).drop("regions")
    reason = (
        F.when(~F.col("__first"), "duplicate_id")
        .when(~F.col("__valid"), "invalid_coordinates")
        .when(F.col("__region").isNull(), "outside_nrw")
    )
    return placed.withColumns({region_id: F.col("__region"), "reason": reason}).drop(
        "__first", "__valid", "__region"
    )


def split_classified(classified: DataFrame, *, lon: str = "lon", lat: str = "lat") -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; a rejected record carries the fixed exception fields."""
    accepted = classified.where(F.col("reason").isNull()).drop("reason")
    values = {"longitude": F.col(lon), "latitude": F.col(lat)}
    rejected = classified.where(F.col("reason").isNotNull()).select(
        *[
            values.get(f, F.col(f) if f in classified.columns else F.lit(None).cast("string")).alias(f)
            for f in EXCEPTION_FIELDS
        ]
    )
    return accepted, rejected


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def unique_or_raise(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    example = duplicate_keys(df, keys).first()
    if example is not None:
        raise ValueError(f"duplicate {label} key: {tuple(example[k] for k in keys)}")
    return df


def violation(name: str, bad: DataFrame) -> DataFrame:
    """A check as one row ``(check, violations)``."""
    return bad.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))


def reconcile(
    source: DataFrame, accepted: DataFrame, rejected: DataFrame, regions: DataFrame, *, ident: str = "id",
    region_id: str = "nuts_code",
) -> DataFrame:
    """``(check, violations)``: nothing lost, ids unique, regions known, reasons allowed."""
    sizes = (
        source.agg(F.count("*").alias("n"))
        .union(accepted.agg(-F.count("*")))
        .union(rejected.agg(-F.count("*")))
        .agg(F.lit("accepted plus rejected equals source").alias("check"), F.abs(F.sum("n")).alias("violations"))
    )
    return (
        sizes.union(violation("accepted ids are unique", duplicate_keys(accepted, [ident])))
        .union(violation("accepted regions are known", accepted.join(regions, region_id, "left_anti")))
        .union(violation("reject reasons are allowed", rejected.where(~F.col("reason").isin(*ALLOWED_REASONS))))
    )


def snapshot_guard(regions: DataFrame, stations: DataFrame, config: RegionConfig = DEFAULT) -> DataFrame:
    """A destructive sync may only start from a non-empty, complete, correctly coded snapshot."""
    empty = stations.agg(
        F.lit("station snapshot is not empty").alias("check"),
        F.when(F.count("*") == 0, 1).otherwise(0).cast("bigint").alias("violations"),
    )
    count = regions.agg(
        F.lit("expected number of regions").alias("check"),
        F.abs(F.count("*") - config.expected_regions).alias("violations"),
    )
    codes = violation("region codes carry the prefix", regions.where(~F.col("nuts_code").startswith(config.region_prefix)))
    return empty.union(count).union(codes)


def population_problems(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """``(nuts_code, problem)``: duplicate, unexpected, missing, or not a positive number."""
    repeated = duplicate_keys(rows, ["nuts_code"]).select("nuts_code", F.lit("duplicate").alias("problem"))
    bad = rows.where(~F.coalesce(F.col("population") > 0, F.lit(False))).select("nuts_code", F.lit("population").alias("problem"))
    year = rows.where(~F.coalesce(F.col("reference_year") > 0, F.lit(False))).select(
        "nuts_code", F.lit("reference_year").alias("problem")
    )
    return repeated.union(key_differences(expected, rows, "nuts_code")).union(bad).union(year)


def run_checks(checks: Sequence[DataFrame], *, strict: bool = False) -> DataFrame:
    """All ``(check, violations)`` rows; strict mode raises on the first one broken."""
    table = checks[0]
    for other in checks[1:]:
        table = table.unionByName(other)
    if strict:
        broken = table.where("violations > 0").limit(20).collect()
        if broken:
            raise ValueError("; ".join(f"{r['check']}: {r['violations']}" for r in broken))
    return table
