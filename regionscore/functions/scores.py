"""Score arithmetic: normalization between bounds, one-decimal rounding, presentation bins."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SCORE_TYPE = "decimal(5,1)"


def normalize_5_95(metric: Column, low: Column, high: Column, inverse: bool = False) -> Column:
    """Position between two bounds on 0-100, clipped; 50 when the bounds coincide, NULL if any is."""
    metric, low, high = (c.cast("double") for c in (metric, low, high))
    clipped = F.least(F.greatest(metric, low), high)
    scaled = 100.0 * (clipped - low) / F.nullif(high - low, F.lit(0.0))
    value = 100.0 - scaled if inverse else scaled
    return (
        F.when(metric.isNull() | low.isNull() | high.isNull(), F.lit(None).cast("double"))
        .when(high == low, F.lit(50.0))
        .otherwise(value)
    )


def round_score(value: Column) -> Column:
    """One decimal, half away from zero, from the double's first 15 significant digits.

    Rounding the double itself would turn 62.249999999999993 into 62.2; as a decimal of 15
    digits it is 62.25 and becomes 62.3.
    """
    wide = "decimal(24,15)"
    size = F.abs(value)
    exact = (
        F.when(size >= 100.0, value.cast("decimal(20,12)").cast(wide))
        .when(size >= 10.0, value.cast("decimal(20,13)").cast(wide))
        .when(size >= 1.0, value.cast("decimal(20,14)").cast(wide))
        .otherwise(value.cast("decimal(20,15)").cast(wide))
    )
    return F.round(exact, 1).cast(SCORE_TYPE)


def weighted_score(terms: Iterable[tuple[Decimal, Decimal, Column]]) -> Column:
    """``round(sum(constant + weight * component), 1)`` in decimals; any NULL component wins."""
    total = None
    for constant, weight, component in terms:
        term = F.lit(weight).cast("decimal(4,2)") * component.cast(SCORE_TYPE)
        if constant:
            term = F.lit(constant).cast("decimal(5,2)") + term
        total = term if total is None else total + term
    return F.round(total, 1).cast(SCORE_TYPE)


def gated(value: Column, reported: Column, expected: Column) -> Column:
    """A total only when everything expected was reported; a partial sum is never a total."""
    return F.when(reported.isNotNull() & (reported == expected), value)


def ratio(part: Column, whole: Column) -> Column:
    """Coverage as a ratio, NULL when nothing is expected."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def published_rank(score: Column, rank: Column) -> Column:
    """A rank is shown only next to the score it ranks."""
    return F.when(score.isNotNull(), rank)


def score_bin(score: Column) -> Column:
    return (
        F.when(score < 35, "<35")
        .when(score < 50, "35-<50")
        .when(score < 65, "50-<65")
        .when(score < 80, "65-<80")
        .when(score >= 80, "80-100")
    )


def change_bin(delta: Column, *, lower_is_better: bool = False) -> Column:
    """Five classes of a change, signed so that an improvement is positive."""
    gain = -delta if lower_is_better else delta
    return (
        F.when(gain >= 10, "+10 or more")
        .when(gain > 0, "0 to +10")
        .when(gain == 0, "No change")
        .when(gain > -10, "-10 to 0")
        .when(gain.isNotNull(), "-10 or less")
    )


def signed_value(value: Column) -> Column:
    text = F.format_string("%.1f", value.cast("double"))
    return F.when(value > 0, F.concat(F.lit("+"), text)).when(value.isNotNull(), text)


def coverage_percentage(value: Column) -> Column:
    """A coverage ratio as a percentage with at most one decimal, a dash when unknown."""
    percent = F.round((value.cast("double") * 100.0).cast("decimal(20,8)"), 1)
    text = F.regexp_replace(F.format_number(percent, 1), r"\.0$", "")
    return F.when(value.isNull(), F.lit("—")).otherwise(F.concat(text, F.lit("%")))


def change_direction(delta: Column) -> Column:
    return F.when(delta > 0, "increase").when(delta < 0, "decrease").when(delta == 0, "unchanged")


def register_sql_functions(spark: SparkSession) -> None:
    """The two scalar functions the SQL surface offers, as SQL functions of the session."""
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION normalize_5_95(
            metric DOUBLE, low DOUBLE, high DOUBLE, inverse_metric BOOLEAN DEFAULT false)
        RETURNS DOUBLE
        RETURN CASE
            WHEN metric IS NULL OR low IS NULL OR high IS NULL THEN NULL
            WHEN high = low THEN 50D
            WHEN inverse_metric THEN 100D - 100D * (least(greatest(metric, low), high) - low) / nullif(high - low, 0D)
            ELSE 100D * (least(greatest(metric, low), high) - low) / nullif(high - low, 0D)
        END
        """
    )
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION normalize_road_class(source_class STRING)
        RETURNS STRING
        RETURN CASE upper(btrim(coalesce(source_class, '')))
            WHEN 'A' THEN 'motorway' WHEN 'B' THEN 'primary'
            WHEN 'L' THEN 'secondary' WHEN 'K' THEN 'tertiary'
            ELSE nullif(lower(btrim(coalesce(source_class, ''))), '')
        END
        """
    )
