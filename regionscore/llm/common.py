"""What the operators share: shipping the package, working tables, stable row positions."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regionscore.storage import materialize, new_path

__all__ = ["documents", "key_name", "materialize", "new_path", "numbered", "once", "positioned", "ship", "u32"]

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Executors then import it whatever their own search path holds.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="regionscore-code-"), "regionscore_llm.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def key_name(doc: str, others: Iterable[str]) -> str:
    """The name of the key column in a result: its own, or ``key_`` before it while another column has that name."""
    taken = {c.lower() for c in others}
    while doc.lower() in taken:
        doc = f"key_{doc}"
    return doc


def u32(column: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, as an unsigned number in a long; of no text as of an empty one."""
    return F.crc32(F.coalesce(column.cast("binary"), F.lit(b"")))


def once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once for a row, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def positioned(written: DataFrame) -> DataFrame:
    """A table read from files, with ``file`` and ``row``: where each row lies.

    Written files do not change, so the position stays the same when a lost task is run
    again, and no file holds more rows than the task that wrote it: rows numbered by file
    are spread evenly whatever their values are.
    """
    return written.select(
        "*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    )


def numbered(table: DataFrame, group: str, number: str, total: str) -> DataFrame:
    """Gapless numbers from 0 within each ``group`` of a positioned table, and the group's size.

    Counts per file and group are summed to offsets; rows are numbered within one file's share
    of a group, so no task holds a whole group.
    """
    counts = table.groupBy(group, "file").agg(F.count("*").alias("n"))
    by_group = Window.partitionBy(group)
    offsets = counts.select(
        F.col(group).alias("_group"),
        F.col("file").alias("_file"),
        (F.sum("n").over(by_group.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_before"),
        F.sum("n").over(by_group).alias(total),
    )
    inside = F.row_number().over(Window.partitionBy(group, "file").orderBy("row")) - 1
    ranked = table.withColumn("_inside", inside.cast("long"))
    return (
        ranked.join(offsets, (F.col(group) == F.col("_group")) & (F.col("file") == F.col("_file")))
        .withColumn(number, F.col("_before") + F.col("_inside"))
        .drop("_group", "_file", "_before", "_inside")
    )
