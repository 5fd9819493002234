"""Thinning, routes, ranked lists and column contracts."""

from pyspark.sql import functions as F

from regionscore.operators import mapdata as MD
from regionscore.operators import relational as RL
from tests import worlds as W


def test_one_station_per_cell_and_pointless_rows_stay(spark):
    rows = [("a", 50.0, 2, 7.01, 51.01), ("b", 100.0, 1, 7.02, 51.02), ("c", 100.0, 1, 7.03, 51.03), ("d", 22.0, 1, 9.0, 51.0), ("e", 1.0, 1, None, None)]
    df = spark.createDataFrame(rows, "source_id string, power_kw double, charging_points int, lon double, lat double")
    assert sorted(r["source_id"] for r in MD.stations_for_zoom(df, 8).collect()) == ["b", "d", "e"]
    assert MD.stations_for_zoom(df, 10).count() == 5
    assert sorted(r["source_id"] for r in MD.stations_for_zoom(df, 3).collect()) == ["b", "d", "e"]


def test_largest_asset_per_cell_and_group(spark):
    rows = [("a", "Windenergie", 2.0), ("b", "Windenergie", 3.0), ("c", "Photovoltaik Freifläche", None), ("d", "Photovoltaik Bauliche", 0.0)]
    df = spark.createDataFrame(rows, "source_id string, technology string, capacity_mw double").withColumns({"lon": F.lit(7.0), "lat": F.lit(51.0)})
    assert sorted(r["source_id"] for r in MD.renewables_for_zoom(df, 11).collect()) == ["b", "c"]
    assert MD.renewables_for_zoom(df, 12).count() == 4


def test_whole_routes_are_kept(spark):
    lines = W.lines(spark, [("1", " A 1 ", [[7, 51], [7.5, 51]]), ("2", "A 1", [[8, 51], [8.5, 51]]), ("3", "A 2", [[7, 51], [7.9, 51]]), ("4", None, [[7, 51], [9, 51]])], "id string, ref string")
    assert sorted(r["id"] for r in MD.top_routes(lines, 1).collect()) == ["1", "2"]
    assert MD.routes_for_zoom(lines, 12).count() == 4


def test_ranked_list_and_column_contracts(spark):
    df = spark.createDataFrame([("DEA02", 5.0, None), ("DEA01", 5.0, None), ("DEA03", None, "why")], "nuts_code string, s double, energy_unavailable_reason string")
    ranked, missing = MD.ranked_list(df, "s")
    assert [r["nuts_code"] for r in ranked.collect()] == ["DEA01", "DEA02"]
    assert [tuple(r) for r in missing.collect()] == [("DEA03", "why")]
    assert RL.columns_in_order(df, ["nuts_code", "s", "energy_unavailable_reason", "geom"]) and not RL.columns_in_order(df, ["s", "nuts_code"])
    assert RL.schema_differences(df.withColumn("x", F.lit(1)), df) == [("x", "int")]
