"""Small hand-made worlds the tests run on."""

from pyspark.sql import functions as F

from regionscore.functions import geometry as G
from regionscore.functions.geojson import geometry_from_json
from regionscore.plans.refresh import Inputs
from regionscore.schemas import ENERGY_CONSUMPTION, RENEWABLE_BALANCE, SOURCE_SNAPSHOTS

STATE = "Nordrhein-Westfalen"


def shape(kind, coordinates):
    """GeoJSON-like python lists as geometry rows: ``(type, json text)``."""
    import json

    return kind, json.dumps(coordinates)


def with_geometry(df):
    return df.withColumn("geom", geometry_from_json(F.col("kind"), F.col("coords"))).drop("kind", "coords")


def box(west, south, east, north):
    return [[west, south], [east, south], [east, north], [west, north], [west, south]]


def districts(spark, rows):
    """rows: (code, ags, name, polygon coordinates)."""
    data = [(c, a, n, STATE, *shape("Polygon", rings)) for c, a, n, rings in rows]
    return with_geometry(
        spark.createDataFrame(data, "nuts_code string, ags string, district_name string, region_name string, kind string, coords string")
    )


def stations(spark, rows):
    """rows: (id, points, power, max point power, lon, lat)."""
    base = spark.createDataFrame(
        rows, "source_id string, charging_points int, power_kw double, max_point_power_kw double, lon double, lat double"
    )
    text = {c: F.lit(None).cast("string") for c in ("street", "postcode", "city", "district_text")}
    return base.withColumns(
        {"operator": F.lit("Fixture"), "status": F.lit("active"), "charger_type": F.lit("x"), "bundesland": F.lit(STATE)} | text
    )


def lines(spark, rows, schema):
    data = [(*r[:-1], *shape("LineString", r[-1])) for r in rows]
    return with_geometry(spark.createDataFrame(data, f"{schema}, kind string, coords string"))


def roads(spark, rows):
    """rows: (id, class, traffic, line)."""
    out = lines(spark, rows, "osm_id string, road_class string, traffic_total double")
    empty = F.lit(None)
    return out.withColumns(
        {
            "name": empty.cast("string"),
            "road_number": empty.cast("string"),
            "traffic_light": empty.cast("double"),
            "traffic_heavy": empty.cast("double"),
            "counting_station_type": empty.cast("string"),
            "source": F.lit("fixture"),
        }
    )


def grid(spark, line_rows, point_rows):
    """line_rows: (id, voltage, line); point_rows: (id, voltage, lon, lat)."""
    data = [(i, "line", v, None, *shape("LineString", c)) for i, v, c in line_rows]
    data += [(i, "substation", v, None, *shape("Point", [x, y])) for i, v, x, y in point_rows]
    return with_geometry(
        spark.createDataFrame(data, "source_id string, asset_type string, voltage string, name string, kind string, coords string")
    )


def renewables(spark, rows):
    """rows: (id, technology, MW, status, lon, lat)."""
    base = spark.createDataFrame(
        rows, "source_id string, technology string, capacity_mw double, status string, lon double, lat double"
    )
    return base.withColumns({"name": F.lit(None).cast("string"), "operator": F.lit(None).cast("string"), "asset_type": F.lit("generator")})


def population(spark, rows):
    """rows: (code, ags, people)."""
    return spark.createDataFrame(
        [(a, c, a, p, 2024, "fixture") for c, a, p in rows],
        "district_code string, nuts_code string, ags string, population int, reference_year int, source string",
    )


def consumption(spark, rows):
    """rows: (year, code, ags, GWh)."""
    return spark.createDataFrame(
        [(y, "M" + a, c, c, a, float(g) if g is not None else None, None, None, None, "fixture") for y, c, a, g in rows],
        ENERGY_CONSUMPTION,
    )


def balance(spark, rows):
    """rows: (year, code, ags, generation, wind, capacity, addition)."""
    number = lambda v: None if v is None else float(v)
    return spark.createDataFrame(
        [
            (y, "M" + a, c, c, a, number(g), 0, number(w), number(k), number(n), "fixture")
            for y, c, a, g, w, k, n in rows
        ],
        RENEWABLE_BALANCE,
    )


def no_snapshots(spark):
    return spark.createDataFrame([], SOURCE_SNAPSHOTS)


def three_squares(spark):
    codes = [("DEA01", "05111", "West", 6), ("DEA02", "05112", "Centre", 7), ("DEA03", "05113", "East", 8)]
    return Inputs(
        districts=districts(spark, [(c, a, n, [box(w, 50, w + 1, 51)]) for c, a, n, w in codes]),
        stations=stations(
            spark,
            [
                ("c-1", 1, 22.0, 22.0, 6.2, 50.2),
                ("c-2", 2, 75.0, 50.0, 7.2, 50.2),
                ("c-3", 3, 150.0, 150.0, 8.2, 50.2),
                ("c-4", 2, 44.0, 22.0, 8.7, 50.7),
                ("c-5", 1, 150.0, None, 8.4, 50.7),
            ],
        ),
        population=population(spark, [("DEA01", "05111", 100000), ("DEA02", "05112", 200000), ("DEA03", "05113", 300000)]),
        roads=roads(
            spark,
            [(f"r-{i}", "primary", 10000.0 * i, [[5.1 + i, 50.5], [5.9 + i, 50.5]]) for i in (1, 2, 3)],
        ),
        grid=grid(
            spark,
            [(f"g-l{i}", v, [[5.1 + i, 50.4], [5.9 + i, 50.4]]) for i, v in ((1, "110 kV"), (2, "220 kV"), (3, "380 kV"))],
            [("g-s1", "110 kV", 6.3, 50.5), ("g-s2", "220 kV", 7.5, 50.5), ("g-s3", "380 kV", 8.7, 50.5)],
        ),
        renewables=renewables(
            spark,
            [
                ("re-1", "solar", 10.0, "In Betrieb", 6.4, 50.4),
                ("re-2", "wind", 20.0, "In Betrieb", 7.4, 50.4),
                ("re-3", "wind", 40.0, "In Betrieb", 8.4, 50.4),
            ],
        ),
        consumption=consumption(spark, []),
        renewable_balance=balance(spark, []),
        snapshots=no_snapshots(spark),
    )


def six_districts(spark):
    west = {"DEA01": 6, "DEA02": 7, "DEA03": 8, "DEA04": 9, "DEA05": 10, "DEA06": 11}
    ags = {c: f"0511{i}" for i, c in enumerate(west, 1)}
    energy = {
        "DEA01": (1000, 300000, 20, 40, 2),
        "DEA02": (1500, 500000, 30, 60, 3),
        "DEA03": (2000, 900000, 50, 90, 5),
        "DEA04": (2000, 900000, 50, 90, 5),
        "DEA05": (2500, 400000, 10, 20, 1),
        "DEA06": (3000, 700000, 40, 70, 4),
    }
    traffic = [10000.0, 20000.0, 30000.0, 30000.0, 15000.0, 5000.0]
    lon = {"DEA01": 6.5, "DEA02": 7.5, "DEA03": 8.4, "DEA04": 9.6, "DEA05": 10.5, "DEA06": 11.5}
    volts = {"DEA01": "110 kV", "DEA02": "220 kV", "DEA03": "380 kV", "DEA04": "380 kV", "DEA05": "110 kV", "DEA06": "110 kV"}
    mw = {"DEA01": 10.0, "DEA02": 20.0, "DEA03": 40.0, "DEA04": 40.0, "DEA05": 5.0, "DEA06": 15.0}
    people = {"DEA01": 100000, "DEA02": 150000, "DEA03": 200000, "DEA04": 200000, "DEA05": 250000, "DEA06": 300000}
    years = (2022, 2023, 2024)
    return Inputs(
        districts=districts(spark, [(c, ags[c], c, [box(w, 50, w + 1, 51)]) for c, w in west.items()]),
        stations=stations(
            spark,
            [
                ("c-1", 2, 44.0, 22.0, 6.5, 50.5),
                ("c-2", 3, 150.0, 150.0, 7.5, 50.5),
                ("c-3", 4, 300.0, 150.0, 8.4, 50.4),
                ("c-4", 4, 300.0, 150.0, 9.6, 50.4),
                ("c-5", 1, 150.0, None, 10.5, 50.5),
            ],
        ),
        population=population(spark, [(c, ags[c], people[c]) for c in west]),
        roads=roads(
            spark,
            [(f"r-{i}", "B", traffic[i], [[6.1 + i, 50.5], [6.9 + i, 50.5]]) for i in range(6)],
        ),
        grid=grid(
            spark,
            [(f"g-l-{c}", volts[c], [[w + 0.1, 50.4], [w + 0.9, 50.4]]) for c, w in west.items() if c != "DEA05"],
            [(f"g-s-{c}", volts[c], lon[c], 50.6) for c in west],
        ),
        renewables=renewables(spark, [(f"re-{c}", "wind", mw[c], "In Betrieb", lon[c], 50.3) for c in west]),
        consumption=consumption(spark, [(y, c, ags[c], e[0]) for c, e in energy.items() for y in years]),
        renewable_balance=balance(spark, [(y, c, ags[c], *e[1:]) for c, e in energy.items() for y in years]),
        snapshots=no_snapshots(spark),
    )


def square(west, south, east, north):
    ring = box(west, south, east, north)
    return G.polygon([(F.lit(x), F.lit(y)) for x, y in ring])
