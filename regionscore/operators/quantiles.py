"""Exact interpolated percentiles and exact global ranks without gathering the values.

A wanted position lies in an interval of values. Counting the values in equal parts of it, with the least and the
largest of each part, gives the part it is in, whose own least and largest value are the next interval; once an interval
holds few values they are counted one by one. A pass returns a bounded number of rows, whatever the values and their number
are, and equal values are always counted together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.config import DEFAULT
from regionscore.storage import materialize

#: Parts of an interval, and the number of values that are counted one by one.
PARTS, FEW = 1024, 4096
#: Distinct scores that one task ranks, about.
RANKED_TOGETHER = 200_000


def exact_percentiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """``(metric, fraction, value)``: linear interpolation at ``fraction * (n - 1)``, NULLs ignored.

    All columns and positions narrow together, a pass over the data each time; an interval shrinks a thousandfold or to
    the values there are. A column without values has no rows in the result. Infinite values are values like others.
    """
    clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    edges = clean.agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high"), F.count(c).alias("n")).alias(c) for c in columns]).first()
    spots = {(c, s) for c in columns if edges[c].n for f in fractions for s in (math.floor(f * (edges[c].n - 1)), math.ceil(f * (edges[c].n - 1)))}
    # (column, position) -> interval it lies in, values before the interval, values in it
    held = {(c, s): (edges[c].low, edges[c].high, 0, edges[c].n) for c, s in spots}
    found: dict[tuple[str, int], float] = {}
    while held:
        for key, (low, high, _, _) in list(held.items()):
            if low == high:
                found[key] = low
                del held[key]
        if not held:
            break
        intervals = sorted({(c, low, high, n <= FEW) for (c, _), (low, high, _, n) in held.items()})
        counts = _counted(clean, intervals)
        for (c, s), (low, high, before, _) in list(held.items()):
            for first, last, n in counts[c, low, high]:
                if s < before + n:
                    held[c, s] = (first, last, before, n)
                    break
                before += n
    rows = []
    for c in columns:
        for f in fractions if edges[c].n else ():
            position = f * (edges[c].n - 1)
            low, high = found[c, math.floor(position)], found[c, math.ceil(position)]
            rows.append((c, float(f), low if low == high else low + (position - math.floor(position)) * (high - low)))
    return df.sparkSession.createDataFrame(rows, "metric string, fraction double, value double")


def _counted(clean: DataFrame, intervals: list[tuple[str, float, float, bool]]) -> dict[tuple[str, float, float], list[tuple[float, float, int]]]:
    """The parts of each interval in order: least value, largest value, number. ``few`` intervals are counted value by value."""

    def part(c: str, low: float, high: float, few: bool) -> Column:
        value = F.col(c)
        if not few and (math.isinf(low) or math.isinf(high)):  # infinite ends apart from what is between
            return F.when(value == low, -1.0).when(value == high, 1.0).otherwise(0.0)
        step = high / PARTS - low / PARTS
        if few or low + step == low:  # few values, or few numbers that they can be
            return value
        return F.least(F.floor((value - low) / step), F.lit(PARTS - 1)).cast("double")

    rows = F.array(*[
        F.when(F.col(c).between(low, high), F.struct(F.lit(i).alias("i"), part(c, low, high, few).alias("part"), F.col(c).alias("value")))
        for i, (c, low, high, few) in enumerate(intervals)
    ])
    hits = clean.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("h")).select("h.*")
    out: dict[tuple[str, float, float], list[tuple[float, float, int]]] = {k[:3]: [] for k in intervals}
    for r in hits.groupBy("i", "part").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n")).collect():
        out[intervals[r.i][:3]].append((r.low, r.high, r.n))
    return {k: sorted(v) for k, v in out.items()}


def bounds(
    df: DataFrame,
    columns: Sequence[str],
    fractions: tuple[float, float] = DEFAULT.percentiles,
    *,
    exact: bool = True,
) -> DataFrame:
    """One row with ``<column>_low`` and ``<column>_high`` for every column, computed right away.

    Exact by default, by the same search whatever the size; NULL and NaN are no values.
    ``exact=False`` opts into the sketch. The result is two numbers per column, so it may be
    kept and reused as a local table.
    """
    low, high = (float(f) for f in fractions)
    spark = df.sparkSession
    names = [f"{c}_{end}" for c in columns for end in ("low", "high")]
    schema = ", ".join(f"`{n}` double" for n in names)
    if exact:
        found = {(r["metric"], r["fraction"]): r["value"] for r in exact_percentiles(df, columns, (low, high)).collect()}
        values = [found.get((c, f)) for c in columns for f in (low, high)]
    else:
        wanted = F.array(F.lit(low), F.lit(high))
        known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
        row = df.agg(*[F.percentile_approx(known[c], wanted, 10_000).alias(c) for c in columns]).first()
        values = [None if row[c] is None else row[c][i] for c in columns for i in (0, 1)]
    return spark.createDataFrame([tuple(values)], schema)


def one_row(table: DataFrame) -> Column:
    """A one-row table as a struct column (an uncorrelated scalar subquery, evaluated once)."""
    return table.select(F.struct(*[F.col(c) for c in table.columns]).alias("row")).scalar()


def rank_desc_nulls_last(df: DataFrame, score: str, rank: str = "rank") -> DataFrame:
    """SQL ``RANK`` by descending score; ties share a rank, NULLs share the one after all scores.

    The rank of a score is one more than the number of rows above it, so it is found from the
    counts per distinct score. Published scores have one decimal (about a thousand distinct
    values); other columns are laid in order over as many tasks as their distinct scores need.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("__s")).agg(F.count("*").alias("__n"))
    size = F.col("__s").cast("double")
    if isinstance(df.schema[score].dataType, T.DecimalType) and df.schema[score].dataType.precision <= 5:
        placed = counts.withColumn("__b", -F.floor(size / 10.0))
    else:
        counts = materialize(counts, "score_counts")
        tasks = max(1, -(-counts.count() // RANKED_TOGETHER))
        placed = materialize(counts.repartitionByRange(tasks, F.desc("__s")).withColumn("__b", F.spark_partition_id()), "scores_in_order")
    per_bucket = placed.groupBy("__b").agg(F.sum("__n").alias("__m"))
    above = Window.partitionBy(F.lit(1)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("__b", F.coalesce(F.sum("__m").over(above), F.lit(0)).alias("__o"))
    within = Window.partitionBy("__b").orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = placed.join(offsets, "__b").select(
        "__s", (F.lit(1) + F.col("__o") + F.coalesce(F.sum("__n").over(within), F.lit(0))).cast("bigint").alias(rank)
    )
    scored = one_row(counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")))
    joined = df.drop(rank).join(ranks, F.col(score) == F.col("__s"), "left").drop("__s")
    return joined.withColumn(
        rank, F.when(F.col(score).isNull(), (scored["n"] + 1).cast("bigint")).otherwise(F.col(rank))
    )
