"""Value functions against hand-worked cases."""

import datetime
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from regionscore.functions import parsing as X
from regionscore.functions import scores as S
from regionscore.functions.projection import project_utm, with_utm
from regionscore.functions import geometry as G
from regionscore.operators.quantiles import bounds, exact_percentiles, rank_desc_nulls_last
from regionscore.operators.rollups import sum_known, sum_yield
from regionscore.operators.scoring import SCORE_MODEL, with_composite


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.select(column.alias("v"), "i").orderBy("i").select("v").collect()]


def test_normalization(spark):
    """Every measure of a grid between, on and beyond every pair of bounds, by the rule itself."""
    measures, lows, widths = (None, -7.25, -3.0, 0.0, 1.5, 6.0, 8.75, 400.0), (None, -6.0, 0.0, 6.0), (0.0, 2.5, 12.0)
    cases = [(m, lo, None if lo is None else lo + w) for m in measures for lo in lows for w in widths] + [(1.5, 0.0, None)]

    def rule(m, lo, hi, inverse):
        if None in (m, lo, hi):
            return None
        share = 0.5 if hi == lo else min(1.0, max(0.0, (m - lo) / (hi - lo)))
        return 100 * (1 - share if inverse else share)

    m, lo, hi = F.col("m"), F.col("lo"), F.col("hi")
    for inverse in (False, True):
        got = values(spark, cases, "m double, lo double, hi double", S.normalize_5_95(m, lo, hi, inverse))
        assert got == [None if (e := rule(*c, inverse)) is None else pytest.approx(e) for c in cases]


def test_rounding_is_half_away_from_zero_on_fifteen_digits(spark):
    rows = [(62.249999999999993,), (0.05,), (99.95,), (2.25,), (100.0,), (None,), (54.94,)]
    got = values(spark, rows, "x double", S.round_score(F.col("x")).cast("double"))
    assert got == [62.3, 0.1, 100.0, 2.3, 100.0, None, 54.9]


def test_composites_use_rounded_parts(spark):
    """Each indicator on parts spread by its own position, complete and with each part missing in turn."""
    for indicator in sorted({t.indicator_score for t in SCORE_MODEL}):
        terms = [t for t in SCORE_MODEL if t.indicator_score == indicator]
        whole = [round(97.3 - 11.7 * i - len(indicator) % 7, 1) for i in range(len(terms))]
        rows = [whole] + [[None if i == gone else v for i, v in enumerate(whole)] for gone in range(len(terms))]
        for parts in rows:
            df = spark.createDataFrame([parts], ", ".join(f"{t.component_score} double" for t in terms))
            got = with_composite(df, indicator).first()[indicator]
            if None in parts:
                assert got is None, indicator
            else:
                total = sum(Decimal(t.constant) + Decimal(t.weight) * Decimal(str(v)) for t, v in zip(terms, parts, strict=True))
                assert Decimal(str(got)) == total.quantize(Decimal("0.1"), ROUND_HALF_UP), indicator


@pytest.mark.parametrize(
    "scores,ranks",
    [
        ((3.1,), (1,)),
        ((12.5, 99.9, 0.0, 55.5), (3, 1, 4, 2)),
        ((44.4, None, 44.4, 8.8, 44.4), (1, 5, 1, 4, 1)),
        ((None, 0.0, None, 0.0, 100.0, 33.3, 33.3), (6, 4, 6, 4, 1, 2, 2)),
        ((None, None), (1, 1)),
    ],
)
def test_rank(spark, scores, ranks):
    df = spark.createDataFrame(list(enumerate(scores)), "i int, s double")
    for kind in ("double", "decimal(5,1)"):
        got = rank_desc_nulls_last(df.withColumn("s", F.col("s").cast(kind)), "s").orderBy("i").collect()
        assert tuple(r["rank"] for r in got) == ranks


def test_percentiles(spark):
    nan = float("nan")
    cases = [((-3.5,), -3.5, -3.5), ((4.0, 8.0, nan), 4.2, 7.8), (tuple(float(i * i) for i in range(41)), 4.0, 1444.0), ((None, 6.0, None, 1.0, 11.0), 1.5, 10.5), ((None, nan), None, None)]
    for given, low, high in cases:
        row = bounds(spark.createDataFrame([(v,) for v in given], "x double"), ["x"]).first()
        assert row["x_low"] == (None if low is None else pytest.approx(low))
        assert row["x_high"] == (None if high is None else pytest.approx(high))


def test_distributed_percentiles_equal_the_built_in(spark):
    hot = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 50 == 1, None).otherwise(F.sqrt("id") - 40).alias("x"), (F.col("id") % 5).alias("y")
    )
    fractions = [0.05, 0.5, 0.95]
    found = {(r["metric"], r["fraction"]): r["value"] for r in exact_percentiles(hot, ["x", "y"], fractions).collect()}
    exact = hot.agg(*[F.percentile(c, F.array(*[F.lit(f) for f in fractions])).alias(c) for c in ("x", "y")]).first()
    for c in ("x", "y"):
        assert [found[(c, f)] for f in fractions] == pytest.approx(exact[c])


def test_voltage_tags(spark):
    """Tags written from numbers in each form that counts, and in forms that do not."""
    cases = {None: None, "  ": None, "high": None, "kV": None, "65 kV extra": None, "15 000": None, "1e5": None, ";;": None}
    for volts in (400, 10_000, 33_000, 65_500, 150_000, 225_000):
        kv = volts / 1000
        cases |= {f"{volts}": kv, f"{kv:g}KV": kv, f"  {kv:g}  kV ": kv, f"{volts}.0": kv, f"-{volts}": None, f"-{kv:g} kV": None, f"x{volts}": None}
        cases |= {f"{volts};{volts * 2}": 2 * kv, f"{volts * 3};{kv:g} kV": 3 * kv, f"0;{volts};?": kv, f"-{volts * 5};{volts}": kv, f"{volts};": kv}
    got = values(spark, [(t,) for t in cases], "t string", X.voltage_kv(F.col("t")))
    assert got == [None if e is None else pytest.approx(e) for e in cases.values()]


def test_connector_power_and_threshold(spark):
    readings = [F.lit(v).cast("string") for v in ("22", "50,0", "invalid", "NaN", "0", "-11")]
    none = [F.lit(v).cast("string") for v in ("", "NaN", "Infinity", "-1", None)]
    row = spark.range(1).select(X.max_point_power(readings), X.max_point_power(none)).first()
    assert tuple(row) == (50.0, None)
    assert values(spark, [(50.0,), (49.999,), (None,)], "p double", X.power_class(F.col("p"))) == ["fast", "normal", None]
    assert values(spark, [("2",), ("0",), ("",), ("x",), ("2,9",)], "p string", X.point_count(F.col("p"))) == [2, 1, 1, 1, 2]


def test_dates_names_and_keys(spark):
    texts = [("a\nLetzte Aktualisierung vom: 22.04.2026;;;",), ("letzte  aktualisierung  vom:31.12.2025",), ("Letzte Aktualisierung vom: 31.02.2026",), ("no date",)]
    assert values(spark, texts, "t string", X.publication_date(F.col("t"))) == [datetime.date(2026, 4, 22), datetime.date(2025, 12, 31), None, None]
    names = [("Köln, kreisfreie Stadt",), ("Mülheim a.d. Ruhr",), ("Große Aue",), (None,)]
    assert values(spark, names, "t string", X.district_key(F.col("t"))) == ["koln", "mulheimanderruhr", "groeaue", ""]
    assert values(spark, [("5111",), ("123456789",)], "t string", X.pad_ags(F.col("t"))) == ["00005111", "123456789"]


def traffic_cases():
    """Volumes by the rule: nothing counted is no figure, no split is no split, and a bad figure names its field."""
    for total in (730.0, 9_876.0, 41_003.0):
        days = (total * 1.125, total * 0.75, total * 0.5)
        for share in (0.0, 0.125, 1.0):
            heavy = total * share
            yield (total, *days, total - heavy, heavy), (total, total - heavy, heavy, None)
        yield (total, *days, 0.0, 0.0), (total, None, None, None)
        yield (0.0, 0.0, total, 0.0, 0.0, 0.0), (None, None, None, "zero all-days total with a positive day-type total")
        yield (total, 0.0, -total, 0.0, 0.0, 0.0), (None, None, None, f"{X.DAY_TYPE_TOTALS[2]} must not be negative")
        yield (total, *days, float("-inf"), 0.0), (None, None, None, "DTVLVA must be finite")
    yield (0.0,) * 6, (None, None, None, None)
    yield (None,) * 6, (None, None, None, None)


TRAFFIC = list(traffic_cases())


def test_district_keys_over_all_characters(spark):
    """The stated rule in plain Python for every character of the basic plane, alone and between letters."""
    names = [f"Ax{chr(c)}y" for c in range(0x21, 0x10000) if not 0xD800 <= c < 0xE000 and not chr(c).isspace()]

    def rule(name):
        whole = unicodedata.normalize("NFKD", name.lower())
        return "".join(c for c in whole if c in "abcdefghijklmnopqrstuvwxyz0123456789")

    got = values(spark, [(n,) for n in names], "t string", X.district_key(F.col("t")))
    assert [(n, g) for n, g in zip(names, got, strict=True) if g != rule(n)] == []


def test_traffic_observations(spark):
    schema = "a double, b double, c double, d double, l double, h double"
    totals = dict(zip(X.DAY_TYPE_TOTALS, (F.col(c) for c in "abcd")))
    got = values(spark, [t for t, _ in TRAFFIC], schema, X.traffic_observation(totals, F.col("l"), F.col("h")))
    assert [tuple(g) for g in got] == [e for _, e in TRAFFIC]


def test_projected_distances(spark):
    df = spark.createDataFrame([(7.6, 51.5, 7.6, 51.525), (7.6, 51.5, 7.63, 51.5)], "a double, b double, c double, d double")
    flat = with_utm(with_utm(df, "a", "b", "x", "y"), "c", "d", "p", "q")
    got = [r[0] for r in flat.select(F.hypot(F.col("x") - F.col("p"), F.col("y") - F.col("q"))).collect()]
    assert got == [pytest.approx(2780.7, abs=0.05), pytest.approx(2082.6, abs=0.05)]
    nested = df.select(project_utm(G.point(F.col("a"), F.col("b")))["parts"][0][0][0].alias("p")).first()["p"]
    plain = flat.select("x", "y").first()
    assert (nested["x"], nested["y"]) == (pytest.approx(plain["x"], abs=1e-6), pytest.approx(plain["y"], abs=1e-6))


def test_technology_sums_keep_unknown_apart_from_zero(spark):
    rows = [(1.0, None, 2.0, 5.0), (0.0, None, 2.0, 5.0), (None, None, 2.0, 5.0), (1.0, 3.0, None, 5.0)]
    df = spark.createDataFrame(rows, "`A Leistung (MW)` double, `A Stromertrag (MWh)` double, `B Leistung (MW)` double, `B Stromertrag (MWh)` double")
    total, unknown = sum_yield(df, ["A Stromertrag (MWh)", "B Stromertrag (MWh)", "C Stromertrag (MWh)"])
    known = sum_known(df, ["A Leistung (MW)", "B Leistung (MW)", "C Leistung (MW)"])
    got = [tuple(r) for r in df.select(total, unknown, known).collect()]
    assert got == [(None, 1, 3.0), (5.0, 0, 2.0), (None, 1, None), (8.0, 0, None)]


def test_presentation(spark):
    assert values(spark, [(8.0,), (-8.0,), (0.0,)], "x double", S.signed_value(F.col("x"))) == ["+8.0", "-8.0", "0.0"]
    assert values(spark, [(0.5,), (0.3333,), (None,), (1.0,)], "x double", S.coverage_percentage(F.col("x"))) == ["50%", "33.3%", "—", "100%"]
    assert values(spark, [(34.9,), (35.0,), (80.0,), (None,)], "x double", S.score_bin(F.col("x"))) == ["<35", "35-<50", "80-100", None]
