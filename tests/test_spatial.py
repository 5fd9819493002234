"""Spatial operators against brute force and the small worlds."""

import dataclasses
import math
import random

import pytest
from pyspark.sql import functions as F

from regionscore.functions import geometry as G
from regionscore.functions.projection import with_utm
from regionscore.operators import region_index as RI
from regionscore.operators import spatial as SP
from regionscore.operators.nearest import nearest
from regionscore.operators.quality import classify_points, split_classified
from regionscore.operators.validity import geometry_report
from regionscore.plans import measures as M
from tests import worlds as W

HOLED = [W.box(7, 51, 7.5, 51.5), W.box(7.2, 51.2, 7.3, 51.3)]


@pytest.fixture(scope="module")
def pair(spark):
    return W.districts(spark, [("DEA01", "1", "a", HOLED), ("DEA02", "2", "b", [W.box(7.5, 51, 8, 51.5)])])


@pytest.fixture(scope="module")
def pair_index(pair):
    return RI.build_index(pair, "nuts_code", "geom")


POINTS = [("interior", 7.1, 51.1), ("hole", 7.25, 51.25), ("hole-edge", 7.2, 51.25), ("corner", 7.3, 51.3), ("shared", 7.5, 51.2), ("outside", 9.0, 51.2), ("bad", float("nan"), 51.2)]


def test_containment(spark, pair_index):
    points = spark.createDataFrame(POINTS, "id string, lon double, lat double")
    owned = {r["id"]: r["nuts_code"] for r in SP.assign_regions(points, point_id="id", index=pair_index).collect()}
    assert owned == {"interior": "DEA01", "hole-edge": "DEA01", "corner": "DEA01", "shared": "DEA01"}
    single = SP.assign_regions(points, point_id="id", index=pair_index, ambiguous="reject")
    assert "shared" not in {r["id"] for r in single.collect()}
    assert SP.assign_regions(points, point_id="id", index=pair_index, ambiguous="all").count() == 5
    assert SP.in_any_region(points, index=pair_index).count() == 4


def test_crowded_cells_give_the_same_owners(spark, pair_index, pair):
    points = spark.createDataFrame(POINTS, "id string, lon double, lat double")
    crowded = dataclasses.replace(pair_index, most_packed=0)
    packed = SP.assign_regions(points, point_id="id", index=pair_index).select("id", "nuts_code")
    general = SP.assign_regions(points, point_id="id", index=crowded).select("id", "nuts_code")
    assert sorted(packed.collect()) == sorted(general.collect())


def test_records_that_share_an_id_are_matched_one_by_one(spark, pair_index):
    points = spark.createDataFrame([("twice", 7.1, 51.1), ("twice", 9.0, 51.2), ("twice", 7.7, 51.2), (None, 7.1, 51.1)], "id string, lon double, lat double")
    crowded = dataclasses.replace(pair_index, most_packed=0)
    for index in (pair_index, crowded):
        rows = SP.assign_regions(points, point_id="id", index=index).collect()
        assert {(r["id"], r["lon"], r["nuts_code"]) for r in rows} == {("twice", 7.1, "DEA01"), ("twice", 7.7, "DEA02"), (None, 7.1, "DEA01")}
        assert len(rows) == 3
        asked = SP.region_matches(points, index, "id", keep_where=F.col("lon") < 7.5).collect()
        assert {(r["id"], r["lon"], tuple(r["regions"] or ())) for r in asked} == {("twice", 7.1, ("DEA01",)), ("twice", 9.0, ()), ("twice", 7.7, ()), (None, 7.1, ("DEA01",))}


def test_random_polygons_against_per_row_containment(spark):
    rng = random.Random(5)
    shapes = []
    for i in range(12):
        cx, cy, n = rng.uniform(6, 9), rng.uniform(50, 52), rng.randint(5, 40)
        ring = [[cx + math.cos(2 * math.pi * k / n) * (s := rng.uniform(0.1, 0.7)), cy + math.sin(2 * math.pi * k / n) * s] for k in range(n)]
        shapes.append((f"DEA{i:02d}", "0", "x", [ring + [ring[0]]]))
    regions = W.districts(spark, shapes)
    points = spark.createDataFrame([(i, rng.uniform(5.5, 9.5), rng.uniform(49.5, 52.5)) for i in range(2000)], "id int, lon double, lat double")
    index = RI.build_index(regions, "nuts_code", "geom", cell=0.11)
    quick = SP.assign_regions(points, point_id="id", index=index, ambiguous="all").select("id", "nuts_code")
    brute = points.join(regions, G.covers(F.col("geom"), F.col("lon"), F.col("lat"))).select("id", "nuts_code")
    assert sorted(quick.collect()) == sorted(brute.collect())


def star(rng, cx, cy, n, low, high):
    out = [[cx + math.cos(2 * math.pi * k / n) * (s := rng.uniform(low, high)), cy + math.sin(2 * math.pi * k / n) * s] for k in range(n)]
    return [*out, out[0]]


@pytest.mark.parametrize("cell", [2.5, 0.7])
def test_split_cells_against_per_row_containment(spark, monkeypatch, cell):
    rng = random.Random(8)
    monkeypatch.setattr(RI, "MAX_EDGES_PER_CELL", 6)
    shapes = [(f"DEA{i:02d}", "0", "x", [star(rng, rng.uniform(6, 9), rng.uniform(50, 52), rng.randint(30, 90), 0.2, 0.8)]) for i in range(8)]
    shapes.append(("DEA90", "0", "x", [W.box(5, 49, 10, 53), W.box(6.5, 50.5, 8.5, 51.5)]))
    regions = W.districts(spark, shapes)
    points = spark.createDataFrame([(i, rng.uniform(5.5, 9.5), rng.uniform(49.5, 52.5)) for i in range(1500)], "id int, lon double, lat double")
    index = RI.build_index(regions, "nuts_code", "geom", cell=cell)
    assert index.depths and index.cells.where("depth > 0").count() > 100
    quick = SP.assign_regions(points, point_id="id", index=index, ambiguous="all").select("id", "nuts_code")
    brute = points.join(regions, G.covers(F.col("geom"), F.col("lon"), F.col("lat"))).select("id", "nuts_code")
    assert sorted(quick.collect()) == sorted(brute.collect())
    assert sorted(SP.in_any_region(points, index=index).select("id").collect()) == sorted(brute.select("id").distinct().collect())
    lines = W.lines(spark, [(f"l{i}", [[x := rng.uniform(5, 9), y := rng.uniform(49.5, 52)], [x + rng.uniform(0, 1), y + rng.uniform(-1, 1)]]) for i in range(60)], "id string")
    whole = RI.build_index(regions, "nuts_code", "geom", cell=0.05)
    met = [sorted(SP.intersect_pairs(lines, "id", i).collect()) for i in (index, whole)]
    assert met[0] == met[1] and len(met[0]) > 60


def test_positions_and_outlines_on_the_lines_of_the_grid(spark):
    # cell sides, corners, vertices, horizontal and vertical edges all fall on multiples of the cell
    shapes = [
        ("DEA01", "0", "x", [[[0, 0], [4, 0], [4, 2], [2, 2], [2, 4], [0, 4], [0, 0]], [[0.5, 0.5], [1, 1], [0.5, 1], [0.5, 0.5]]]),
        ("DEA02", "0", "x", [[[4, 0], [6, 2], [4, 4], [2, 2], [4, 0]]]),
        ("DEA03", "0", "x", [[[-1, -1], [7, -1], [7, 5], [-1, 5], [-1, -1]], [[1, 3], [3, 3], [3, 4.5], [1, 4.5], [1, 3]]]),
        ("DEA04", "0", "x", [[[0, 4], [1, 3], [2, 4], [3, 3], [4, 4], [2, 5], [0, 4]]]),
    ]
    regions = W.districts(spark, shapes)
    points = spark.createDataFrame([(i * 100 + j, i / 4 - 2, j / 4 - 2) for i in range(40) for j in range(32)], "id int, lon double, lat double")
    brute = sorted(points.join(regions, G.covers(F.col("geom"), F.col("lon"), F.col("lat"))).select("id", "nuts_code").collect())
    for cell in (1.0, 0.5, 0.25, 2.0, 0.3):
        index = RI.build_index(regions, "nuts_code", "geom", cell=cell)
        quick = SP.assign_regions(points, point_id="id", index=index, ambiguous="all").select("id", "nuts_code")
        assert sorted(quick.collect()) == brute, cell


def test_a_detailed_outline_has_few_edges_a_cell(spark):
    n = 20_000
    ring_ = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((7 + 0.6 * F.cos(i * (2 * math.pi / n))).alias("x"), (51 + 0.6 * F.sin(i * (2 * math.pi / n))).alias("y")))
    circle = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(F.concat(ring_, F.slice(ring_, 1, 1)))).alias("parts"))
    regions = spark.range(1).select(F.lit("DEA01").alias("nuts_code"), circle.alias("geom"))
    index = RI.build_index(regions, "nuts_code", "geom")
    assert index.cells.agg(F.max(F.size("edges"))).first()[0] <= 2 * RI.MAX_EDGES_PER_CELL
    points = spark.range(3000).select("id", (6.3 + F.rand(1) * 1.4).alias("lon"), (50.3 + F.rand(2) * 1.4).alias("lat"))
    points = spark.createDataFrame(points.collect(), points.schema)
    inside = {r["id"] for r in points.collect() if math.hypot(r["lon"] - 7, r["lat"] - 51) <= 0.6}
    assert {r["id"] for r in SP.assign_regions(points, point_id="id", index=index).collect()} == inside


def test_polygons_around_regions(spark):
    regions = SP.with_region_measures(W.districts(spark, [
        ("DEA01", "1", "a", [W.box(7, 51, 7.2, 51.2)]),
        ("DEA02", "2", "b", [W.box(9, 51, 9.4, 51.4), W.box(9.1, 51.1, 9.3, 51.3)]),
    ]))
    sites = [
        ("around one", [W.box(6, 50, 8, 52)]),
        ("around both", [W.box(5, 49, 11, 53)]),
        ("ring around one", [W.box(5, 49, 8.5, 53), W.box(6.5, 50.5, 7.7, 51.7)]),
        ("in the hole", [W.box(9.15, 51.15, 9.25, 51.25)]),
        ("inside", [W.box(7.05, 51.05, 7.1, 51.1)]),
        ("away", [W.box(11, 54, 12, 55)]),
    ]
    features = W.districts(spark, [(n, "0", "x", rings) for n, rings in sites]).select(F.col("nuts_code").alias("id"), F.lit(1).alias("kw"), "geom")
    index = RI.build_index(regions, "nuts_code", "geom")
    met = {tuple(r) for r in SP.intersect_pairs(features, "id", index, keep=["kw"]).select("nuts_code", "id", "kw").collect()}
    assert met == {("DEA01", "around one", 1), ("DEA01", "around both", 1), ("DEA02", "around both", 1), ("DEA01", "inside", 1)}
    near = {r["id"] for r in SP.within_distance(features, regions, feature_id="id", metres=5000.0).collect()}
    assert near == {"around one", "around both", "in the hole", "inside"}


def test_clipped_lengths_against_per_row_clipping(spark):
    rng = random.Random(9)
    regions = SP.with_region_measures(W.districts(spark, [("DEA01", "1", "a", HOLED), ("DEA02", "2", "b", [W.box(7.5, 51, 8, 51.5)])]))
    rows = []
    for i in range(60):
        a = [rng.uniform(6.8, 8.2), rng.uniform(50.9, 51.6)]
        rows.append((f"l{i}", [a, [a[0] + rng.uniform(-0.5, 0.5), a[1] + rng.uniform(-0.4, 0.4)], [a[0] + 0.1, a[1] + 0.3]]))
    lines = W.lines(spark, rows, "id string")
    quick = SP.clip_lengths(lines, regions, line_id="id")
    from regionscore.functions.projection import project_utm

    brute = lines.withColumn("m", project_utm(F.col("geom"))).crossJoin(regions.select("nuts_code", "geom_m")).select(
        "nuts_code", "id", (G.clipped_length(F.col("m"), F.col("geom_m")) / 1000).alias("km")
    )
    a = {(r["nuts_code"], r["id"]): r["length_km"] for r in quick.collect()}
    b = {(r["nuts_code"], r["id"]): r["km"] for r in brute.collect()}
    assert len(a) > 30
    for key, km in b.items():
        assert a.get(key, 0.0) == pytest.approx(km, abs=1e-6), key


def test_a_line_along_a_border_counts_for_both_sides(spark):
    square = lambda code, w: (code, "0", "x", [W.box(w, 50, w + 1, 51)])
    regions = SP.with_region_measures(W.districts(spark, [square("DEA01", 8), square("DEA02", 9)]))
    line = W.lines(spark, [("border", [[9.0, 50.2], [9.0, 50.8]])], "id string")
    got = {r["nuts_code"]: r["length_km"] for r in SP.clip_lengths(line, regions, line_id="id").collect()}
    assert got["DEA01"] == pytest.approx(got["DEA02"]) and got["DEA01"] == pytest.approx(66.7, abs=0.2)


def test_nearest_is_in_metres_and_absent_features_stay_unknown(spark):
    origins = with_utm(spark.createDataFrame([("o", 7.6, 51.5)], "id string, lon double, lat double"), "lon", "lat")
    places = spark.createDataFrame([("north", 7.6, 51.525), ("east", 7.63, 51.5)], "f string, lon double, lat double")
    segments = SP.point_segments(with_utm(places, "lon", "lat"), "f", "x", "y")
    row = nearest(origins, segments, origin_id="id", feature_id="f", x="x", y="y").first()
    assert row["f"] == "east" and row["distance_m"] == pytest.approx(2082.6, abs=0.05)
    none = nearest(origins, segments.limit(0), origin_id="id", feature_id="f", x="x", y="y").collect()
    assert [(r["id"], r["f"], r["distance_m"]) for r in none] == [("o", None, None)]


def test_nearest_against_brute_force_with_a_crowd_and_lonely_origins(spark):
    rng = random.Random(3)
    crowd = [(i, rng.gauss(500_000, 40), rng.gauss(5_600_000, 40)) for i in range(600)]
    spread = [(1000 + i, rng.uniform(300_000, 700_000), rng.uniform(5_400_000, 5_800_000)) for i in range(300)]
    features = spark.createDataFrame(crowd + spread, "f int, x double, y double")
    origins = spark.createDataFrame(
        [(i, rng.uniform(100_000, 900_000), rng.uniform(5_200_000, 6_000_000)) for i in range(80)] + [(99, 500_000.0, 5_600_000.0)], "o int, x double, y double"
    )
    segments = SP.point_segments(features, "f", "x", "y")
    got = {r["o"]: r["distance_m"] for r in nearest(origins, segments, origin_id="o", feature_id="f", x="x", y="y").collect()}
    for o in origins.collect():
        best = min(((o["x"] - x) ** 2 + (o["y"] - y) ** 2) ** 0.5 for _, x, y in crowd + spread)
        assert got[o["o"]] == pytest.approx(best, abs=1e-6)


def test_margin(spark):
    regions = SP.with_region_measures(W.districts(spark, [("DEA01", "1", "a", [W.box(7, 51, 7.5, 51.5)])]))
    points = spark.createDataFrame([("in", 7.2), ("near", 6.95), ("far", 6.5)], "id string, lon double").withColumn(
        "geom", G.point(F.col("lon"), F.lit(51.2))
    )
    assert sorted(r["id"] for r in SP.within_distance(points, regions, feature_id="id").collect()) == ["in", "near"]


def test_classification_order_and_reasons(spark, pair_index):
    rows = [
        ("inside", 7.1, 51.1), ("boundary", 7.0, 51.2), ("outside", 9.0, 51.2), ("invalid", float("nan"), 51.2), ("inside", 7.6, 51.2),
        ("late", 181.0, 91.0), ("late", 7.1, 51.1),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal int, id string, lon double, lat double")
    accepted, rejected = split_classified(classify_points(df, pair_index))
    assert sorted((r["id"], r["nuts_code"]) for r in accepted.collect()) == [("boundary", "DEA01"), ("inside", "DEA01")]
    assert sorted((r["id"], r["reason"]) for r in rejected.collect()) == [
        ("inside", "duplicate_id"), ("invalid", "invalid_coordinates"), ("late", "duplicate_id"), ("late", "invalid_coordinates"), ("outside", "outside_nrw"),
    ]
    with pytest.raises(ValueError):
        classify_points(df.withColumn("id", F.lit(" ")), pair_index)


def ring(*points):
    return [list(p) for p in (*points, points[0])]


HEXAGON = ring((7.0, 51.0), (7.2, 50.9), (7.4, 51.0), (7.4, 51.2), (7.2, 51.3), (7.0, 51.2))
L_SHAPE = ring((8.0, 50.0), (8.9, 50.0), (8.9, 50.3), (8.3, 50.3), (8.3, 50.8), (8.0, 50.8))
OUTLINES = {
    "hexagon": ("Polygon", [HEXAGON], None),
    "l shape with two holes": ("Polygon", [L_SHAPE, ring((8.1, 50.1), (8.2, 50.1), (8.15, 50.2)), ring((8.6, 50.1), (8.7, 50.1), (8.7, 50.2), (8.6, 50.2))], None),
    "three parts": ("MultiPolygon", [[HEXAGON], [L_SHAPE], [ring((9.1, 52.0), (9.2, 52.0), (9.15, 52.1))]], None),
    "triangles meeting in a point": ("MultiPolygon", [[ring((6.0, 50.0), (6.5, 50.2), (6.0, 50.4))], [ring((6.5, 50.2), (7.0, 50.0), (7.0, 50.4))]], None),
    "two distinct points": ("Polygon", [ring((6.3, 51.7), (6.4, 51.7), (6.3, 51.7))], "too few points"),
    "star": ("Polygon", [ring((7.0, 52.0), (7.6, 52.0), (7.1, 51.6), (7.3, 52.3), (7.5, 51.6))], "self-intersection"),
    "hexagon cut by a hole": ("Polygon", [HEXAGON, ring((7.3, 51.05), (7.6, 51.1), (7.3, 51.15))], "self-intersection"),
    "hole far away": ("Polygon", [HEXAGON, ring((9.0, 50.9), (9.1, 50.9), (9.05, 51.0))], "hole outside shell"),
    "overlapping triangles": ("MultiPolygon", [[ring((6.0, 50.0), (6.6, 50.0), (6.3, 50.6))], [ring((6.3, 50.1), (6.9, 50.1), (6.6, 50.7))]], "self-intersection"),
    "triangles sharing a side": ("MultiPolygon", [[ring((6.0, 50.0), (6.6, 50.0), (6.3, 50.6))], [ring((6.0, 50.0), (6.3, 49.5), (6.6, 50.0))]], "self-intersection"),
    "open triangle": ("Polygon", [[[6.0, 50.0], [6.6, 50.0], [6.3, 50.6], [6.1, 50.4]]], "unclosed exterior ring"),
    "point": ("Point", [6.5, 50.5], "unsupported geometry"),
}


def test_outline_validity(spark):
    df = W.with_geometry(spark.createDataFrame([(n, *W.shape(k, c)) for n, (k, c, _) in OUTLINES.items()], "name string, kind string, coords string"))
    got = {}
    for r in geometry_report(df, region_id="name").collect():
        got.setdefault(r["name"], set()).add(r["reason"])
    assert got == {n: {reason} for n, (_, _, reason) in OUTLINES.items() if reason}


def triangle(x, y, dx, dy, ex, ey):
    return ring((x, y), (x + dx, y + dy), (x + ex, y + ey))


def test_holes_that_touch_in_a_cycle_cut_the_interior(spark):
    shell = W.box(0, 0, 20, 20)
    a, b, c = triangle(4, 4, 4, 0, 2, 3), triangle(8, 4, 4, 0, 2, 3), triangle(6, 7, 4, 0, 2, 4)  # a-b at (8,4), a-c at (6,7), b-c at (10,7)
    chain = [triangle(2 + 2 * i, 12, 2, 0, 1, 2) for i in range(7)]  # each touches the next in a point
    cases = {
        "cycle of three": [shell, a, b, c],
        "two of them": [shell, a, b],
        "chain": [shell, *chain],
        "chain from side to side": [shell, ring((0, 10), (4, 9), (4, 11)), ring((4, 9), (12, 8), (12, 12)), ring((12, 8), (20, 10), (13, 11))],
        "chain to one side": [shell, ring((0, 10), (4, 9), (4, 11)), ring((4, 9), (12, 8), (12, 12))],
        "all in one point": [shell, triangle(10, 10, 4, 0, 2, 2), triangle(10, 10, -4, 0, -2, 2), triangle(10, 10, -1, -4, 1, -4)],
        "two points": [shell, ring((0, 5), (5, 10), (0, 15), (2, 10))],
    }
    df = W.districts(spark, [(n, "0", "x", rings) for n, rings in cases.items()])
    got = {(r["nuts_code"], r["reason"]) for r in geometry_report(df).collect()}
    assert got == {(n, "disconnected interior") for n in ("cycle of three", "chain from side to side", "two points")}


def test_long_edges_among_many_short_ones(spark):
    # 4,000 short edges and two that are thousands of times as long, oblique to the grid
    from regionscore.operators import validity

    n = 4000
    wave = [[i * 0.001, (i % 2) * 0.001] for i in range(n)]
    line = [*wave, [4000.0, 3000.0], [0.0, 3000.0], wave[0]]
    df = W.districts(spark, [("DEA01", "0", "x", [line])])
    rings = validity._ring_rows(df, "nuts_code", "geom")
    cells = validity._edge_cells(validity._edges(rings))
    assert cells.count() < 4 * n
    assert geometry_report(df).collect() == []


def test_voltage_and_traffic_coverage(spark):
    regions = W.districts(spark, [("DEA01", "1", "a", [W.box(7, 51, 7.5, 51.5)]), ("DEA02", "2", "b", [W.box(7.5, 51, 8, 51.5)])])
    d = M.prepare_districts(regions)
    line = lambda w, y: [[w + 0.1, y], [w + 0.2, y]]
    grid = W.grid(spark, [("l1", "110000", line(7, 51.1)), ("l2", None, line(7, 51.2)), ("l3", "0", line(7, 51.3)), ("l4", "unknown", line(7.5, 51.1))], [("s", "110 kV", 7.2, 51.2)])
    raw = {r["nuts_code"]: r for r in M.grid_raw(d, grid, cell=5000.0).collect()}
    assert raw["DEA01"]["line_voltage_coverage"] == pytest.approx(1 / 3) and raw["DEA02"]["line_voltage_coverage"] == 0
    assert raw["DEA02"]["voltage_weighted_line_density"] is None and raw["DEA02"]["substation_count"] == 0
    roads = W.roads(spark, [("r1", "B", 12000.0, line(7, 51.1)), ("r2", "B", None, line(7, 51.1)), ("r3", "B", None, line(7.5, 51.1))])
    t = {r["nuts_code"]: r for r in M.transport_raw(d, roads, cell=5000.0).collect()}
    assert t["DEA01"]["traffic_intensity_dtv"] == pytest.approx(12000) and t["DEA01"]["traffic_length_coverage"] == pytest.approx(0.5)
    assert t["DEA02"]["traffic_intensity_dtv"] is None and t["DEA02"]["traffic_measured_length_km"] == 0


def test_two_population_figures_give_two_rows(spark):
    regions = W.districts(spark, [("DEA01", "05111", "a", [W.box(7, 51, 7.5, 51.5)])])
    people = spark.createDataFrame(
        [("x", "DEA01", None, 10, 2024, "s"), ("y", None, "05111", 20, 2024, "s"), ("z", "DEA01", "05111", 10, 2024, "s")],
        "district_code string, nuts_code string, ags string, population int, reference_year int, source string",
    )
    got = sorted((r["population"], r["copies"]) for r in M.population_of(regions, people).collect())
    assert got == [(10, 2), (20, 1)]


def _long_lines(spark, n):
    """Lines of up to a third of the field's width, which cross one another everywhere."""
    i = F.col("id")
    ax, ay = (i * 37 % 101).cast("double") * 10, (i * 53 % 103).cast("double") * 10
    bx, by = ax + (i % 7 - 3) * 100.0, ay + (i % 5 - 2) * 150.0
    return spark.range(n).select(F.concat(F.lit("l"), i.cast("string")).alias("f"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))


def _by_brute_force(origins, segments):
    pairs = origins.crossJoin(segments).withColumn("d", G.point_segment_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")]))
    best = pairs.groupBy("o").agg(F.min(F.struct("d", "f")).alias("b")).select("o", "b.f", "b.d")
    return {r.o: (r.f, pytest.approx(r.d, abs=1e-9)) for r in best.collect()}


def test_a_few_origins_never_cut_long_features_into_cells(spark, monkeypatch):
    from regionscore.operators import nearest as N

    def cut(*_):
        raise AssertionError("long features were cut into cells for a few origins")

    monkeypatch.setattr(N, "segment_pieces", cut)
    lines = _long_lines(spark, 500)
    origins = spark.createDataFrame([("a", 500.0, 500.0), ("b", -400.0, 20.0), ("c", 333.0, 777.0)], "o string, x double, y double")
    unknown = spark.createDataFrame([("n", None, 1.0), (None, 5.0, 5.0)], "o string, x double, y double")
    got = nearest(origins.union(unknown), lines.union(lines.limit(0)), origin_id="o", feature_id="f", x="x", y="y")
    found = {r.o: (r.f, r.distance_m) for r in got.collect()}
    assert found == {**_by_brute_force(origins, lines), "n": (None, None), None: (None, None)}


def test_pieces_of_long_features_follow_the_origins(spark, monkeypatch):
    from regionscore.operators import nearest as N

    lines, build, pieces = _long_lines(spark, 20_000), N.build_quadtree, []

    def counted(*args):
        tree = build(*args)
        pieces.append(tree.leaves.count())
        return tree

    monkeypatch.setattr(N, "build_quadtree", counted)
    origins = spark.range(70).select(F.col("id").alias("o"), (F.col("id") * 17 % 71 * 20.0 - 200).alias("x"), (F.col("id") * 29 % 73 * 20.0 - 200).alias("y"))
    got = {r.o: (r.f, r.distance_m) for r in nearest(origins, lines, origin_id="o", feature_id="f", x="x", y="y").collect()}
    assert got == _by_brute_force(origins, lines)
    assert pieces[0] < 25 * 20_000


def test_many_origins_take_the_lowest_of_equally_near_features(spark):
    i = F.col("id")
    points = spark.range(400).select(F.format_string("p%03d", 399 - i).alias("f"), (i % 20 * 10.0).alias("x"), (F.floor(i / 20) * 10.0).alias("y"))
    origins = spark.range(300).select(i.alias("o"), (i % 20 * 10.0 + 5).alias("x"), (F.floor(i / 20) * 14.0 - 40).alias("y"))
    segments = points.select("f", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    got = {r.o: (r.f, r.distance_m) for r in nearest(origins, segments, origin_id="o", feature_id="f", x="x", y="y").collect()}
    assert got == _by_brute_force(origins, segments)


def test_small_outlines_stay_in_their_rows(spark, monkeypatch):
    from regionscore.operators import validity as V

    def shifted(west):
        step = [(0, 0), (18, 0), (18, 5), (9, 5), (9, 12), (0, 12)]
        left, far, across = [(1, 1), (4, 1), (2, 4)], [(22, 2), (25, 2), (24, 5)], [(7, 3), (11, 4), (11, 8), (7, 8)]
        frame, first, second = [(0, 0), (30, 0), (30, 30), (0, 30)], [(2, 2), (26, 4), (6, 26)], [(8, 8), (12, 8), (9, 11)]
        star, thin = [(0, 0), (12, 10), (12, 0), (6, 12), (0, 10)], [(3, 3), (5, 3)]
        touching = [(0, 12), (4, 8), (9, 12), (4, 10)]
        shapes = [[[step, left]], [[step, far]], [[step, across]], [[frame, first, second]], [[star]], [[thin]], [[step], [far]], [[step], [left]], [[step, left, touching]]]
        return [(f"{west}-{i}", [[[(x + west, float(y)) for x, y in (*ring, ring[0])] for ring in part] for part in shape]) for i, shape in enumerate(shapes)]

    rows = [(name, ("MultiPolygon", parts)) for west in (0.0, 40.0) for name, parts in shifted(west)]
    kind = "name string, geom struct<type: string, parts: array<array<array<struct<x: double, y: double>>>>>"
    df = spark.createDataFrame(rows, kind)
    by_cells = {}
    with monkeypatch.context() as m:
        m.setattr(V, "SMALL_OUTLINE_EDGES", 0)
        by_cells = {(r.name, r.reason) for r in V.topology_report(df, region_id="name").collect()}

    def cut(*_, **__):
        raise AssertionError("a small outline was cut into cells")

    monkeypatch.setattr(V, "region_cells", cut)
    monkeypatch.setattr(V, "edge_cells", cut)
    got = {(r.name, r.reason) for r in V.topology_report(df, region_id="name").collect()}
    assert got == by_cells
    assert {(n.split("-")[1], reason) for n, reason in got} >= {("1", "hole outside shell"), ("3", "nested holes"), ("4", "self-intersection"), ("5", "too few points"), ("7", "nested shells")}
    assert not {n for n, _ in got} & {"0.0-0", "40.0-0", "0.0-6"}
