from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from regionscore.config import RegionConfig
from regionscore.plans import publish as P
from regionscore.plans import refresh as R
from regionscore.sinks.layers import BOX, read_box, read_layer, write_layer
from regionscore.plans import scenario as SC
from regionscore.plans import verify as V
from regionscore.sinks.export import current_generation
from regionscore.storage import materialize
from tests import worlds as W

THREE = RegionConfig(expected_regions=3)
SIX = RegionConfig(expected_regions=6)
PROPOSAL = "id string, charging_points int, power_kw double, max_point_power_kw double, lon double, lat double"


@pytest.fixture(scope="module")
def three(spark):
    return R.analyse(W.three_squares(spark), THREE, cell=20_000.0)


@pytest.fixture(scope="module")
def six(spark):
    return R.analyse(W.six_districts(spark), SIX, cell=20_000.0)


def by_code(df, *columns):
    return {r["nuts_code"]: tuple(r[c] for c in columns) for r in df.select("nuts_code", *columns).collect()}


def test_power_classes_use_the_largest_point_power(three):
    counts = by_code(
        three["district_metrics"], "chargers_total", "fast_chargers_total", "normal_chargers_total", "unknown_power_chargers_total"
    )
    assert counts == {"DEA01": (1, 0, 1, 0), "DEA02": (1, 1, 0, 0), "DEA03": (3, 1, 1, 1)}


def test_ranks_and_priority_formula(three):
    scored = materialize(three["ev_scored"], "scored")
    assert sorted(r[0] for r in by_code(scored, "priority_rank").values()) == [1, 2, 3]
    again = F.round(
        F.lit(Decimal("0.60")) * F.col("charger_deficit_score") + F.lit(Decimal("0.40")) * F.col("infrastructure_opportunity_score"), 1
    )
    assert scored.where(F.col("investment_priority_score") != again).count() == 0
    assert set(by_code(scored, "data_quality_flag").values()) == {("complete_proxy_inputs",)}


def test_without_energy_rows_everything_says_why(three):
    energy = by_code(three["energy"], "reporting_year", "energy_unavailable_reason", "grid_absorption_risk_proxy_score")
    assert set(energy.values()) == {(None, "no_municipal_energy_data", None)}


def test_empty_scenario_equals_the_baseline(spark, three):
    none = spark.createDataFrame([], PROPOSAL)
    measures = materialize(SC.scenario_measures(three.districts, three["district_metrics"], none, cell=20_000.0), "m")
    compared = SC.scenario_compare(measures, three["baseline"], three["ev_bounds"], three["opportunity"]).collect()
    assert len(compared) == 3
    for row in compared:
        assert row["ev_readiness_score_delta"] == 0 and row["chargers_total_delta"] == 0
        assert row["baseline_priority_rank"] == row["scenario_priority_rank"]


@pytest.fixture(scope="module")
def proposed(spark, three):
    one = spark.createDataFrame([("p-1", 4, 150.0, 150.0, 6.6, 50.6)], PROPOSAL)
    quick = materialize(SC.scenario_measures(three.districts, three["district_metrics"], one, cell=20_000.0), "m")
    full = materialize(
        SC.scenario_measures_full(three.districts, three["district_metrics"], three.inputs.stations, one, cell=20_000.0), "m"
    )
    return quick, full


def test_a_proposal_adds_exactly_itself(spark, three, proposed):
    compared = SC.scenario_compare(proposed[0], three["baseline"], three["ev_bounds"], three["opportunity"])
    deltas = by_code(
        compared, "chargers_total_delta", "charging_points_total_delta", "fast_chargers_total_delta", "unknown_power_chargers_total_delta"
    )
    assert deltas == {"DEA01": (1, 4, 1, 0), "DEA02": (0, 0, 0, 0), "DEA03": (0, 0, 0, 0)}
    stored = materialize(compared, "compared")
    assert V.check_scenario(stored).where("violations > 0").count() == 0
    view = SC.project_view(stored, "change").select("chargers_total", "infrastructure_opportunity_score").collect()
    assert sorted(r[0] for r in view) == [0, 0, 1] and all(r[1] == 0 for r in view)
    none = spark.createDataFrame([], PROPOSAL)
    empty = SC.scenario_measures(three.districts, three["district_metrics"], none, cell=20_000.0)
    before = materialize(SC.scenario_compare(materialize(empty, "m"), three["baseline"], three["ev_bounds"], three["opportunity"]), "before")
    assert V.check_proposal_added(before, stored, "DEA01", 4).first()["violations"] == 0
    assert V.check_proposal_added(before, stored, "DEA02", 4).first()["violations"] == 2
    assert V.check_restored(before, before).first()["violations"] == 0
    assert V.check_restored(before, stored).first()["violations"] > 0
    assert V.check_scenario(stored, before).where("violations > 0").count() == 0
    assert P.publish_scenario(stored, three.districts).where("geom is null").count() == 0


def test_incremental_scenario_equals_the_full_one(proposed):
    quick, full = proposed
    names = sorted(full.columns)
    rounded = [F.round(F.col(c).cast("double"), 6) if c not in ("nuts_code", "ags", "district_name") else F.col(c) for c in names]
    assert sorted(quick.select(*rounded).collect()) == sorted(full.select(*rounded).collect())


def test_mirrored_districts_tie_and_missing_lines_propagate(six):
    scored = by_code(six["ev_scored"], "ev_readiness_score", "investment_priority_score", "priority_rank", "data_quality_flag")
    assert scored["DEA03"] == scored["DEA04"]
    assert scored["DEA05"][1] is None and scored["DEA05"][3] == "missing_infrastructure_input"
    assert scored["DEA05"][2] == 6
    grid = by_code(six["grid"], "grid_readiness_proxy_score", "grid_data_quality_flag")
    assert grid["DEA05"] == (None, "no_mapped_grid_lines")
    renewable = by_code(six["renewable"], "renewable_technology_diversity_score")
    assert set(renewable.values()) == {(Decimal("50.0"),)}


def test_energy_scores_and_reasons(six):
    energy = by_code(six["energy"], "reporting_year", "energy_unavailable_reason", "energy_data_quality_flag", "consumption_mwh")
    assert energy["DEA01"] == (2024, None, "hybrid_complete", 1_000_000.0)
    assert energy["DEA05"][1] == "unavailable_grid_readiness_proxy"


def test_all_checks_pass_and_see_a_mutation(spark, six):
    table = {r["check"]: r["violations"] for r in R.verify(six, SIX).collect()}
    assert len(table) > 30 and {k: v for k, v in table.items() if v} == {}
    baseline = materialize(six["baseline"], "b")
    broken = baseline.withColumn("transport_load_score", F.col("transport_load_score") + F.lit(Decimal("0.1")).cast("decimal(5,1)"))
    result = V.check_model_recomputation(broken.withColumn("transport_load_score", F.col("transport_load_score").cast("decimal(5,1)")), six["score_model"])
    assert result.first()["violations"] > 0
    with pytest.raises(ValueError):
        R.run_checks([V.check_district_contract(baseline.withColumn("line_voltage_coverage", F.lit(2.0)), SIX)], strict=True)


def test_refresh_publishes_only_after_checks(spark, tmp_path):
    inputs = W.six_districts(spark)
    R.refresh(spark, inputs, str(tmp_path), SIX, cell=20_000.0)
    served = current_generation(spark, str(tmp_path))
    assert served
    with pytest.raises(ValueError):
        R.refresh(spark, inputs, str(tmp_path), RegionConfig(expected_regions=5))
    assert current_generation(spark, str(tmp_path)) == served
    layer = spark.read.parquet(f"{tmp_path}/generations/{served}/ev_baseline_metrics")
    assert layer.count() == 6
    compared = spark.read.parquet(f"{tmp_path}/generations/{served}/ev_scenario_metrics")
    assert compared.count() == 6 and compared.where("chargers_total_delta <> 0").count() == 0
    layers = {n: read_layer(spark, f"{tmp_path}/generations/{served}/{n}") for n in ("chargers", "ev_baseline_metrics", "district_priority")}
    assert R.verify_layers(layers, SIX).where("violations > 0").count() == 0
    broken = {**layers, "district_priority": layers["district_priority"].withColumn("own", F.lit(1)).limit(5), "chargers": layers["chargers"].drop("status")}
    assert {r["check"] for r in R.verify_layers(broken, SIX).where("violations > 0").collect()} == {
        "district_priority has no columns of its own", "published district_priority has 6 rows", "chargers: required columns",
    }
    manifest = R.export(spark, str(tmp_path), str(tmp_path / "map"), SIX)
    assert {r["layer"]: r["features"] for r in manifest.collect()} == {"districts": 6, "chargers": 5, "regional_roads": 6, "renewables": 0}
    kinds = V.check_layer(layer, "districts", ["nuts_code", "ev_readiness_score"], ["Polygon", "MultiPolygon"])
    assert kinds.where("violations > 0").count() == 0
    assert V.check_layer(layer, "districts", ["absent"], ["Point"]).where("violations > 0").count() == 2


def test_box_reads_skip_files(spark, tmp_path):
    from regionscore.functions import geometry as G

    points = spark.range(4000).select("id", (F.rand(1) * 20).alias("lon"), (F.rand(2) * 20 + 40).alias("lat"))
    layer = spark.createDataFrame(points.collect(), points.schema).withColumn("geom", G.point(F.col("lon"), F.col("lat")))
    layer = layer.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast(layer.schema["geom"].dataType).alias("geom")))
    path = str(tmp_path / "layer")
    write_layer(layer, path, rows_per_file=100)
    found = read_box(spark, path, 3.0, 43.0, 5.0, 45.0)
    want = {r.id for r in layer.where("lon BETWEEN 3 AND 5 AND lat BETWEEN 43 AND 45").collect()}
    assert {r.id for r in found.collect()} == want and want
    assert found.columns == layer.columns and read_layer(spark, path).count() == 4001
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all(f"({c}" in plan.split("PushedFilters:")[1].split("]")[0] for c in BOX)
    # few files have a row in the box, so the statistics of the others rule them out
    import pyarrow.parquet as pq

    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in sorted((tmp_path / "layer").glob("*.parquet"))]
    names = [groups[0].column(i).path_in_schema for i in range(groups[0].num_columns)]
    w, s_, e, n = (names.index(c) for c in BOX)
    met = [g for g in groups if g.column(w).statistics.min <= 5 and g.column(e).statistics.max >= 3 and g.column(s_).statistics.min <= 45 and g.column(n).statistics.max >= 43]
    assert len(groups) > 30 and len(met) < len(groups) / 4
