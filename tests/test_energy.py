"""Coverage cases of the municipal panel and the workbook preparation."""

import pytest
from pyspark.sql import functions as F

from regionscore.plans.energy import energy_balance_raw, local_energy_balance
from regionscore.sources import tables as ST
from tests import worlds as W

A, B = "05111000", "05111001"


def used(*values):
    return [(y, "DEA01", m, v) for y, m, v in values]


def held(rows):
    return [(y, "DEA01", m, g, w, 1.0, n) for y, m, g, w, n in rows]


FULL = [
    (2022, A, 200.0, 10.0, 1.0), (2022, B, 90.0, 4.0, 0.5), (2023, A, 210.0, 10.5, 1.0), (2023, B, 95.0, 4.2, 0.5),
    (2024, A, 220.0, 11.0, 1.0), (2024, B, 110.0, 5.4, 0.5),
]
BOTH = used((2024, A, 120.0), (2024, B, 60.0))
CASES = {
    "complete": (BOTH, held(FULL), (2, 180000.0, 2, 3, 4.5, None)),
    "municipality missing": (used((2024, A, 120.0)), held(FULL), (1, None, 2, 3, 4.5, "incomplete_consumption_coverage")),
    "true zero": (used((2024, A, 120.0), (2024, B, 0.0)), held(FULL), (2, 120000.0, 2, 3, 4.5, None)),
    "growth year missing": (BOTH, held([r if r[:2] != (2023, B) else (*r[:4], None) for r in FULL]), (2, 180000.0, 2, 2, None, "incomplete_growth_window")),
    "stock incomplete": (BOTH, held([r if r[:2] != (2024, B) else (*r[:3], None, r[4]) for r in FULL]), (2, 180000.0, 1, 3, 4.5, "incomplete_renewable_coverage")),
    "nothing consumed": (used((2024, A, 0.0), (2024, B, 0.0)), held(FULL), (2, 0.0, 2, 3, 4.5, "zero_consumption_denominator")),
}


@pytest.mark.parametrize("name", CASES)
def test_coverage(spark, name):
    consumption, renewable, expected = CASES[name]
    districts = spark.createDataFrame([("DEA01", "05111", "x", 100.0)], "nuts_code string, ags string, district_name string, area_km2 double")
    raw = energy_balance_raw(districts, W.consumption(spark, consumption), W.balance(spark, renewable))
    bounds = spark.createDataFrame([(0.0, 1.0, 0.0, 1.0)], "renewable_balance_ratio_low double, renewable_balance_ratio_high double, renewable_growth_density_mw_per_km2_low double, renewable_growth_density_mw_per_km2_high double")
    grid = spark.createDataFrame([("DEA01", 50.0)], "nuts_code string, grid_readiness_proxy_score double")
    r = local_energy_balance(raw, bounds, grid).first()
    got = (
        r["consumption_municipalities_reported"], r["consumption_mwh"], r["renewable_municipalities_reported"], r["growth_years_reported"],
        r["renewable_net_addition_3y_mw"], r["energy_unavailable_reason"],
    )
    assert r["reporting_year"] == 2024 and got == expected


def sheets(spark):
    base = "Jahr int, Gemeinde string, Kreis string, AGS string"
    key = lambda y: (y, "Teststadt", "Teststadt", "5111000")
    consumption = spark.createDataFrame([(*key(2023), 90.0), (*key(2024), 100.0)], f"{base}, `Stromverbrauch (GWh)` double")
    stock = spark.createDataFrame(
        [(*key(2024), 1.0, 10.0, 0.0, None, 9.0, 5.0), (*key(2025), 2.0, 15.0, 3.0, None, 9.0, 6.0)],
        f"{base}, `Biomasse: Leistung (MW)` double, `Biomasse: Stromertrag (MWh)` double, `Deponiegas: Leistung (MW)` double, "
        "`Deponiegas: Stromertrag (MWh)` double, `Speicher: Batteriespeicher Leistung (MW)` double, `Wind: Leistung (MW)` double",
    )
    growth = spark.createDataFrame([(*key(2022), 1.0, 100.0), (*key(2024), 3.0, 100.0)], f"{base}, `Wind: Leistung (MW)` double, `Speicher: Batteriespeicher Leistung (MW)` double")
    districts = spark.createDataFrame([("DEA11", "Teststadt, kreisfreie Stadt")], "nuts_code string, district_name string")
    return consumption, stock, growth, districts


def test_workbook_rows(spark):
    rows, renewable, year = ST.prepare_energy(*sheets(spark))
    assert year.first()[0] == 2024
    assert {(r["year"], r["ags"], r["nuts_code"], r["consumption_gwh"], r["industry_gwh"]) for r in rows.collect()} == {
        (2023, "05111000", "DEA11", 90.0, None), (2024, "05111000", "DEA11", 100.0, None),
    }
    got = {
        r["year"]: (r["published_generation_mwh"], r["generation_components_unknown"], r["wind_capacity_mw"], r["renewable_capacity_mw"], r["renewable_net_addition_mw"])
        for r in renewable.collect()
    }
    assert got == {2022: (None, 0, None, None, 1.0), 2024: (10.0, 0, 5.0, 6.0, 3.0), 2025: (None, 1, 6.0, 11.0, None)}


def test_workbook_errors(spark):
    consumption, stock, growth, districts = sheets(spark)
    with pytest.raises(ValueError, match="duplicate"):
        ST.prepare_energy(consumption.union(consumption), stock, growth, districts)
    with pytest.raises(ValueError, match="unmapped"):
        ST.prepare_energy(consumption.withColumn("Kreis", F.lit("Elsewhere")), stock, growth, districts)
    with pytest.raises(ValueError, match="missing required"):
        ST.prepare_energy(consumption.drop("AGS"), stock, growth, districts)
    with pytest.raises(ValueError, match="ambiguous"):
        ST.prepare_energy(consumption, stock, growth, districts.union(districts.withColumn("nuts_code", F.lit("DEA12"))))
    with pytest.raises(Exception, match="must be finite"):
        ST.prepare_energy(consumption.withColumn("Stromverbrauch (GWh)", F.lit(float("inf"))), stock, growth, districts)[0].collect()
