"""Published layers laid out for box reads: boxes as columns, neighbours in the same files.

Rows are written in the order of a space-filling curve over the middle of their boxes, so a file and each group of rows
in it covers a small area, and the least and largest values that Parquet keeps of the box columns let a reader of a
box skip what lies elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionscore.functions import geometry as G

#: Box of a feature in degrees, after the published columns.
BOX = ("box_west", "box_south", "box_east", "box_north")
#: Bits of the curve along each axis.
BITS = 16
ROWS_PER_FILE = 500_000


def with_box(layer: DataFrame, geom: str = "geom") -> DataFrame:
    """The layer with its boxes; NULL without a position."""
    box = G.bbox(F.col(geom))
    return layer.withColumn("__box", box).select(
        *layer.columns, *[F.col(f"__box.{f}").alias(c) for c, f in zip(BOX, ("xmin", "ymin", "xmax", "ymax"), strict=True)]
    )


def _spread(value: Column) -> Column:
    """Bits 0 to 15 moved to the even places."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return value


def curve(lon: Column, lat: Column) -> Column:
    """Place along a Z-shaped curve over the whole globe: near in number means near on the map."""

    def cell(value: Column, low: float, wide: float) -> Column:
        at = F.floor((value - low) / wide * (1 << BITS))
        return F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), at)).cast("bigint")

    return _spread(cell(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(cell(lat, -90.0, 180.0)), 1))


def write_layer(layer: DataFrame, path: str, *, geom: str = "geom", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write a layer with a geometry for box reads; one without is written as it is."""
    if geom not in layer.columns:
        layer.write.mode("errorifexists").parquet(path)
        return
    west, south, east, north = (F.col(c) for c in BOX)
    placed = with_box(layer, geom).withColumn("__z", curve((west + east) / 2, (south + north) / 2))
    files = max(1, -(-layer.count() // rows_per_file))
    placed.repartitionByRange(files, "__z").sortWithinPartitions("__z").drop("__z").write.mode("errorifexists").parquet(path)


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """A written layer in its published columns."""
    layer = spark.read.parquet(path)
    return layer.drop(*BOX)


def read_box(spark: SparkSession, path: str, west: float, south: float, east: float, north: float, *, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Features of a written layer whose box meets the given one, in the published columns.

    Plain comparisons of plain columns: they reach the file statistics. Features without a position are not found.
    """
    w, s, e, n = (F.col(c) for c in BOX)
    found = spark.read.parquet(path).where((w <= east) & (e >= west) & (s <= north) & (n >= south))
    if where is not None:
        found = found.where(where)
    found = found.drop(*BOX)
    return found.limit(limit) if limit is not None else found
