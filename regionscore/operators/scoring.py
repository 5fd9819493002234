"""The score model as data, and the one kernel every score goes through."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.config import FORMULA_VERSION
from regionscore.functions.scores import SCORE_TYPE, normalize_5_95, round_score, weighted_score
from regionscore.operators.quantiles import one_row


@dataclass(frozen=True)
class Term:
    sort_order: int
    indicator: str
    indicator_score: str
    component_score: str
    weight: str
    constant: str
    measure: str | None = None
    unit: str | None = None
    inverse: bool | None = None


# The published model, one row per weighted term.
SCORE_MODEL: tuple[Term, ...] = (
    Term(1, "EV Readiness", "ev_readiness_score", "charger_density_score", "0.40", "0",
         "charging_points_per_km2", "charging points per km2", False),
    Term(2, "EV Readiness", "ev_readiness_score", "charger_accessibility_score", "0.30", "0",
         "distance_to_nearest_charger_m", "metres", True),
    Term(3, "EV Readiness", "ev_readiness_score", "population_adjusted_coverage_score", "0.30", "0",
         "charging_points_per_100k_population", "charging points per 100 000 people", False),
    Term(4, "Charger Deficit", "charger_deficit_score", "ev_readiness_score", "-1.00", "100"),
    Term(5, "Transport Load", "transport_load_score", "traffic_intensity_score", "0.60", "0",
         "traffic_intensity_dtv", "vehicles per day", False),
    Term(6, "Transport Load", "transport_load_score", "traffic_road_density_score", "0.25", "0",
         "traffic_weighted_road_density", "vehicle-kilometres per day per km2", False),
    Term(7, "Transport Load", "transport_load_score", "road_proximity_score", "0.15", "0",
         "distance_to_nearest_road_m", "metres", True),
    Term(8, "Grid Readiness Proxy", "grid_readiness_proxy_score", "substation_proximity_score", "0.45", "0",
         "distance_to_nearest_substation_m", "metres", True),
    Term(9, "Grid Readiness Proxy", "grid_readiness_proxy_score", "voltage_line_density_score", "0.35", "0",
         "voltage_weighted_line_density", "kV-kilometres per km2", False),
    Term(10, "Grid Readiness Proxy", "grid_readiness_proxy_score", "substation_density_score", "0.20", "0",
         "substation_density", "substations per km2", False),
    Term(11, "Renewable Context", "renewable_context_score", "renewable_capacity_density_score", "0.70", "0",
         "renewable_capacity_mw_per_km2", "MW per km2", False),
    Term(12, "Renewable Context", "renewable_context_score", "renewable_technology_diversity_score", "0.30", "0",
         "renewable_technology_count", "distinct operating technologies", False),
    Term(13, "Infrastructure Opportunity", "infrastructure_opportunity_score", "transport_load_score", "0.40", "0"),
    Term(14, "Infrastructure Opportunity", "infrastructure_opportunity_score", "grid_readiness_proxy_score", "0.35", "0"),
    Term(15, "Infrastructure Opportunity", "infrastructure_opportunity_score", "renewable_context_score", "0.25", "0"),
    Term(16, "Investment Priority", "investment_priority_score", "charger_deficit_score", "0.60", "0"),
    Term(17, "Investment Priority", "investment_priority_score", "infrastructure_opportunity_score", "0.40", "0"),
    Term(18, "Grid Absorption Risk Proxy", "grid_absorption_risk_proxy_score", "local_energy_balance_score", "0.45", "0",
         "renewable_balance_ratio", "generation divided by consumption", False),
    Term(19, "Grid Absorption Risk Proxy", "grid_absorption_risk_proxy_score", "renewable_growth_score", "0.30", "0",
         "renewable_growth_density_mw_per_km2", "MW added per km2 over the growth window", False),
    Term(20, "Grid Absorption Risk Proxy", "grid_absorption_risk_proxy_score", "grid_readiness_proxy_score", "-0.25", "25"),
)


def terms_of(indicator_score: str) -> list[Term]:
    return [t for t in SCORE_MODEL if t.indicator_score == indicator_score]


def measures_of(*indicator_scores: str) -> list[str]:
    return [t.measure for s in indicator_scores for t in terms_of(s) if t.measure]


def with_components(df: DataFrame, indicator_score: str, bounds: DataFrame) -> DataFrame:
    """Add the rounded component scores of an indicator from its measures and bounds row."""
    row = one_row(bounds)
    new = {}
    for term in terms_of(indicator_score):
        if term.measure:
            low, high = row[f"{term.measure}_low"], row[f"{term.measure}_high"]
            new[term.component_score] = round_score(
                normalize_5_95(F.col(term.measure), low, high, bool(term.inverse))
            )
    return df.withColumns(new)


def with_composite(df: DataFrame, indicator_score: str) -> DataFrame:
    """Add an indicator from its published (rounded) components; a missing one is never made up."""
    terms = [(Decimal(t.constant), Decimal(t.weight), F.col(t.component_score)) for t in terms_of(indicator_score)]
    return df.withColumn(indicator_score, weighted_score(terms))


def normalize_and_combine(df: DataFrame, indicator_score: str, bounds: DataFrame | None = None) -> DataFrame:
    if bounds is not None:
        df = with_components(df, indicator_score, bounds)
    return with_composite(df, indicator_score)


MODEL_SCHEMA = T.StructType(
    [
        T.StructField("formula_version", T.StringType()),
        T.StructField("sort_order", T.IntegerType()),
        T.StructField("indicator", T.StringType()),
        T.StructField("indicator_score", T.StringType()),
        T.StructField("component_score", T.StringType()),
        T.StructField("component_weight", T.DecimalType(4, 2)),
        T.StructField("constant_term", T.DecimalType(5, 2)),
        T.StructField("measure", T.StringType()),
        T.StructField("measure_unit", T.StringType()),
        T.StructField("inverse_measure", T.BooleanType()),
    ]
)


def score_model(spark: SparkSession, *bounds: DataFrame) -> DataFrame:
    """The model relation with the bounds of every measure some bounds row knows."""
    rows = [
        (FORMULA_VERSION, t.sort_order, t.indicator, t.indicator_score, t.component_score,
         Decimal(t.weight), Decimal(t.constant), t.measure, t.unit, t.inverse)
        for t in SCORE_MODEL
    ]
    model = spark.createDataFrame(rows, MODEL_SCHEMA)
    low, high = F.when(F.lit(False), 0.0), F.when(F.lit(False), 0.0)
    for table in bounds:
        row = one_row(table)
        for column in table.columns:
            if column.endswith("_low"):
                measure = column[: -len("_low")]
                low = low.when(F.col("measure") == measure, row[column])
                high = high.when(F.col("measure") == measure, row[f"{measure}_high"])
    return model.withColumns({"lower_bound": low.cast("double"), "upper_bound": high.cast("double")})


def evaluate_model(scored: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """``(key, indicator_score, expected_score, published_score)`` recomputed from the model rows.

    Scores are unpivoted once and met with the model by component name, so this reads the
    published weights instead of repeating the arithmetic.
    """
    names = sorted({t.component_score for t in SCORE_MODEL} | {t.indicator_score for t in SCORE_MODEL})
    present = [n for n in names if n in scored.columns]
    long = scored.select(key, *[F.col(n).cast(SCORE_TYPE).alias(n) for n in present]).unpivot(
        [key], present, "name", "score"
    )
    terms = model.select("indicator_score", "component_score", "component_weight", "constant_term")
    evaluated = (
        long.join(F.broadcast(terms), long["name"] == terms["component_score"])
        .groupBy(key, "indicator_score")
        .agg(
            F.bool_or(F.col("score").isNull()).alias("unavailable"),
            F.round(F.sum(F.col("constant_term") + F.col("component_weight") * F.col("score")), 1)
            .cast(SCORE_TYPE)
            .alias("total"),
        )
    )
    published = long.select(
        key, F.col("name").alias("indicator_score"), F.col("score").alias("published_score")
    )
    return evaluated.join(published, [key, "indicator_score"]).select(
        key,
        "indicator_score",
        F.when(~F.col("unavailable"), F.col("total")).alias("expected_score"),
        "published_score",
    )
