"""The station register: preamble lines, semicolons, decimal commas, one of two encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionscore.config import DEFAULT, RegionConfig
from regionscore.functions.parsing import (
    decimal_comma,
    first_text,
    max_point_power,
    point_count,
    publication_date,
)
from regionscore.sources.splits import read_csv

PREAMBLE_LINES = 10
UTF8_MARK = b"\xef\xbb\xbf"


def file_encoding(spark: SparkSession, path: str) -> DataFrame:
    """``(path, encoding)`` per file: a UTF-8 mark decides, everything else is Windows-1252."""
    files = spark.read.format("binaryFile").load(path)
    mark = F.hex(F.substring("content", 1, 3)) == UTF8_MARK.hex().upper()
    return files.select("path", F.when(mark, "UTF-8").otherwise("windows-1252").alias("encoding"))


def _head(spark: SparkSession, path: str, encoding: str, lines: int) -> list[str]:
    """The first lines of a file: a fixed number, so this stays small whatever the file holds."""
    stream = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = stream.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    java = spark.sparkContext._jvm.java.io
    opened = system.open(stream)
    reader = java.BufferedReader(java.InputStreamReader(opened, encoding))
    try:
        found = []
        for _ in range(lines):
            line = reader.readLine()
            if line is None:
                break
            found.append(line.lstrip("﻿"))
        return found
    finally:
        reader.close()


def _mark_of(spark: SparkSession, path: str) -> str:
    first = _head(spark, path, "ISO-8859-1", 1)
    return "UTF-8" if first and first[0].startswith(UTF8_MARK.decode("latin-1")) else "windows-1252"


def read_station_register(
    spark: SparkSession,
    path: str,
    state: str = DEFAULT.region_name,
    *,
    preamble: int = PREAMBLE_LINES,
    sep: str = ";",
) -> tuple[DataFrame, object]:
    """``(stations, publication date or None)`` of one state.

    The column names come from the line after the preamble, so the scan itself needs no header:
    preamble and header rows do not carry the state and drop out with the state filter.
    ``ordinal`` orders the records as the file does. Splits of a file are read in parallel, line breaks
    in quoted fields included.
    """
    encoding = _mark_of(spark, path)
    head = _head(spark, path, encoding, preamble + 1)
    if len(head) <= preamble:
        raise ValueError("station register has no header line")
    date = spark.range(1).select(publication_date(F.lit("\n".join(head[:preamble])))).first()[0]
    names = [h.strip().strip('"') for h in head[preamble].split(sep)]
    raw = read_csv(spark, path, [f"c{i}" for i in range(len(names))], sep=sep, encoding=encoding, skip_first=False)
    place = {name: f"c{i}" for i, name in reversed(list(enumerate(names)))}

    def text(name: str) -> Column:
        return F.col(place[name]) if name in place else F.lit(None).cast("string")

    def reading(i: int) -> Column:
        plain, unit = f"Nennleistung Stecker{i}", f"Nennleistung Stecker{i} [kW]"
        return F.coalesce(text(plain if plain in place else unit), F.lit(""))

    selected = raw.where(text("Bundesland") == state)
    points = point_count(text("Anzahl Ladepunkte"))
    return (
        selected.select(
            text("Ladeeinrichtungs-ID").alias("id"),
            first_text(text("Anzeigename (Karte)"), text("Betreiber"), default="Charging station").alias("name"),
            text("Betreiber").alias("operator"),
            text("Status").alias("status"),
            text("Art der Ladeeinrichtung").alias("charger_type"),
            points.alias("charging_points"),
            points.alias("connectors"),
            decimal_comma(text("Nennleistung Ladeeinrichtung [kW]")).alias("power_kw"),
            max_point_power([reading(i) for i in range(1, 7)]).alias("max_point_power_kw"),
            text("Kreis/kreisfreie Stadt").alias("district_text"),
            F.lit(state).alias("region"),
            F.lit(state).alias("state"),
            decimal_comma(text("Längengrad")).alias("lon"),
            decimal_comma(text("Breitengrad")).alias("lat"),
            "ordinal",
        ),
        date,
    )


def station_rows(accepted: DataFrame) -> DataFrame:
    """Classified register records in the station table's layout (street, postcode, city unknown)."""
    unknown = F.lit(None).cast("string")
    return accepted.select(
        F.col("id").alias("source_id"),
        "operator",
        "status",
        "charger_type",
        "charging_points",
        "power_kw",
        "max_point_power_kw",
        unknown.alias("street"),
        unknown.alias("postcode"),
        unknown.alias("city"),
        "district_text",
        F.col("state").alias("bundesland"),
        "lon",
        "lat",
    )


def snapshot_row(spark: SparkSession, date, config: RegionConfig = DEFAULT) -> DataFrame:
    """The source-date row of a register load; empty when the register states no date."""
    return (
        spark.range(1)
        .select(
            F.lit(config.station_source_key).alias("source_key"),
            F.lit(date).cast("date").alias("snapshot_date"),
            F.lit(config.station_source_name).alias("source_name"),
            F.lit('Stated in the register preamble as "Letzte Aktualisierung vom"').alias("source_note"),
            F.current_timestamp().alias("recorded_at"),
        )
        .where(F.col("snapshot_date").isNotNull())
    )
