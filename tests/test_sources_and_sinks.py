"""Readers, exports, provenance and the proposal feed on small files."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from regionscore.config import RegionConfig
from regionscore.functions import geometry as G
from regionscore.operators import mapdata as MD
from regionscore.operators import relational as RL
from regionscore.operators.region_index import build_index
from regionscore.plans import scenario as SC
from regionscore.sinks import export as EX
from regionscore.sinks import provenance as PV
from regionscore.sources import features as SF
from regionscore.sources import inventory as IN
from regionscore.sources import tables as ST
from regionscore.sources.register import file_encoding, read_station_register, snapshot_row, station_rows
from regionscore.streaming.proposals import FEED_SCHEMA, start_proposal_feed, stored_proposals
from tests import worlds as W

HEADER = "Ladeeinrichtungs-ID;Bundesland;Breitengrad;Längengrad;Nennleistung Ladeeinrichtung [kW];Anzahl Ladepunkte;Nennleistung Stecker1;Nennleistung Stecker2 [kW];Betreiber"
ROWS = ["a;Nordrhein-Westfalen;51,2;7,1;44;2;22;50,0;Op", "b;Bayern;48;11;44;2;22;;Op", "c;Nordrhein-Westfalen;51,3;x;;;NaN;;"]


@pytest.mark.parametrize("encoding,label", [("utf-8-sig", "UTF-8"), ("cp1252", "windows-1252")])
def test_station_register(spark, tmp_path, encoding, label):
    lines = ["header"] * 7 + ["Letzte Aktualisierung vom: 22.04.2026;;;", "header", "header", HEADER, *ROWS]
    path = tmp_path / "register.csv"
    path.write_text("\n".join(lines), encoding=encoding)
    assert file_encoding(spark, str(path)).first()["encoding"] == label
    stations, date = read_station_register(spark, str(path))
    assert date == datetime.date(2026, 4, 22)
    got = {r["id"]: r for r in stations.orderBy("ordinal").collect()}
    assert list(got) == ["a", "c"]
    a, c = got["a"], got["c"]
    assert (a["lon"], a["lat"], a["power_kw"], a["max_point_power_kw"], a["charging_points"]) == (7.1, 51.2, 44.0, 50.0, 2)
    assert (c["lon"], c["max_point_power_kw"], c["charging_points"], c["name"]) == (None, None, 1, "Charging station")
    assert station_rows(stations).where("street is null and city is null").count() == 2
    assert snapshot_row(spark, date).count() == 1 and snapshot_row(spark, None).count() == 0


def collection(tmp_path, name, features):
    path = tmp_path / name
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}), encoding="utf-8")
    return str(path)


def feature(kind, coordinates, ident=None, **properties):
    out = {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}
    return out | ({"id": ident} if ident else {})


def test_feature_readers(spark, tmp_path):
    grid = collection(
        tmp_path, "grid.geojson",
        [feature("LineString", [[7, 51], [7.1, 51]], "w1", power="line", voltage="110000"), feature("Point", [7, 51, 3], power="substation", **{"@id": "n2"}),
         feature("Point", [7, 51], "n3", power="tower"), feature("Point", [7, 51], power="transformer")],
    )
    accepted, rejected = SF.read_grid(spark, grid)
    assert sorted((r["source_id"], r["asset_type"], r["geom"]["type"]) for r in accepted.collect()) == [("n2", "substation", "Point"), ("w1", "line", "LineString")]
    assert [r["reason"] for r in rejected.collect()] == ["missing id"]
    roads = collection(tmp_path, "roads.geojson", [feature("LineString", [[7, 51], [7.1, 51]], "m1", highway="motorway", ref="A 1"), feature("Point", [7, 51], "m2", highway="motorway"), feature("LineString", [[7, 51], [7.1, 51]], "m3", highway="primary")])
    accepted, rejected = SF.read_motorways(spark, roads)
    assert [r["source_id"] for r in accepted.collect()] == ["m1"] and [r["reason"] for r in rejected.collect()] == ["wrong geometry type"]
    units = collection(tmp_path, "units.geojson", [feature("Polygon", [W.box(7, 51, 8, 52)], NUTS_ID="DEA11", NAME_LATN="D"), feature("Polygon", [W.box(7, 51, 8, 52)], NUTS_ID="DE111", NAME_LATN="S")])
    assert [r["nuts_code"] for r in SF.read_regions(spark, units).collect()] == ["DEA11"]
    accepted, rejected = SF.region_rows(spark, units)
    assert accepted.count() == 2 and rejected.count() == 0
    stations = collection(tmp_path, "st.geojson", [feature("Point", [7.1, 51.2], id="a", power_kw=22, state="NRW"), feature("Point", [True, 51.2], id="b"), feature("Point", [181, 51], id="c"), feature("LineString", [[7, 51], [8, 51]], id="d"), feature("Point", [7, 51])])
    accepted, rejected = SF.read_stations(spark, stations)
    assert [(r["source_id"], r["power_kw"], r["bundesland"], r["lon"]) for r in accepted.collect()] == [("a", 22.0, "NRW", 7.1)]
    assert sorted(r["reason"] for r in rejected.collect()) == ["invalid coordinates", "invalid coordinates", "missing id", "wrong geometry type"]
    other = tmp_path / "no.geojson"
    other.write_text('{"type":"Feature"}')
    with pytest.raises(ValueError):
        SF.read_regions(spark, str(other))
    head = tmp_path / "head.json"
    head.write_text('{"snapshot_date":"2026-04-22"}')
    assert SF.snapshot_header(spark, str(head)).first()["snapshot_date"] == datetime.date(2026, 4, 22)


def test_population_statistics_and_plants(spark, tmp_path):
    path = tmp_path / "pop.json"
    path.write_text(json.dumps({"records": [{"nuts_code": "DEA11", "population": 10, "reference_year": 2024}, {"nuts_code": "DEA12", "population": 1.5, "reference_year": 2024}, {"nuts_code": "XX", "population": 5, "reference_year": 2024}]}))
    expected = spark.createDataFrame([("DEA11",), ("DEA12",), ("DEA13",)], "nuts_code string")
    rows, problems = ST.read_population(spark, str(path), expected)
    assert rows.where("nuts_code = 'DEA11'").first()["source"] == "Eurostat demo_r_pjanaggr3"
    assert sorted(tuple(r) for r in problems.collect()) == [("DEA12", "population"), ("DEA13", "missing"), ("XX", "unexpected")]
    doc = tmp_path / "stat.json"
    doc.write_text(json.dumps({"dimension": {"geo": {"category": {"index": {"DEA11": 0}}}, "time": {"category": {"index": {"2022": 0, "2023": 1, "2024": 2}}}}, "value": {"0": 5, "1": 7}}))
    assert tuple(ST.latest_observation(ST.read_statistics(spark, str(doc))).first()) == ("DEA11", 2023, 7)
    plants = tmp_path / "plants.csv"
    names = IN.PLANT_COLUMNS
    row = {n: "x" for n in names} | {"id": "p1", "state": "Nordrhein-Westfalen", "lat": "51", "lon": "7", "capacity_net_bnetza": "12.5"}
    plants.write_text("\n".join([",".join(names), ",".join(row[n] for n in names), ",".join((row | {"id": "p2", "lat": ""})[n] for n in names), ",".join((row | {"state": "Bayern"})[n] for n in names)]))
    assert [(r["source_id"], r["capacity_mw"]) for r in ST.read_plants(spark, str(plants)).collect()] == [("p1", 12.5)]


def test_catalogs_and_format_report(spark, tmp_path):
    first, second = tmp_path / "a.csv", tmp_path / "b.csv"
    first.write_text("dataset_id,source_url,access_type\none,u1,public\ntwo,u2,public_large\n")
    second.write_text("dataset_id,url,access_type\ntwo,v2,manual\nthree,v3,public\n")
    catalog = ST.read_catalogs(spark, [str(first), str(second)])
    assert sorted((r["dataset_id"], r["source_url"], r["url"], r["access_type"]) for r in catalog.collect()) == [("one", "u1", None, "public"), ("three", None, "v3", "public"), ("two", None, "v2", "manual")]
    wanted = spark.createDataFrame([("one",), ("four",)], "dataset_id string")
    chosen, unknown = ST.select_sources(catalog, ids=wanted)
    assert [r[0] for r in unknown.collect()] == ["four"] and chosen.count() == 1
    files = [
        ("a.geojson", "x", b'{"type":"FeatureCollection","features":[]}'), ("b.geojson", "x", b'{"type":"Feature"}'), ("c.json", "x", b"<html>"),
        ("d.csv", "x", b"a,b\n1,2\n"), ("e.csv", "x", b"a,b\n1\n"), ("f.csv", "x", b"a,b\n"), ("g.csv", "x", b'a,b\n"1,5",2\n'),
        ("h.csv", "bnetza_charging_register_nrw", ("\n".join(["p"] * 10 + ["Ladeeinrichtungs-ID;Bundesland;Straße", "1;2;3"])).encode("cp1252")),
        ("i.csv", "bnetza_charging_register_nrw", ("\n".join(["p"] * 10 + ["Nummer;Bundesland", "1;2"])).encode("cp1252")),
    ]
    report = {r["path"]: r["problem"] for r in IN.format_report(spark.createDataFrame([(p, d, bytearray(c)) for p, d, c in files], "path string, dataset_id string, content binary")).collect()}
    assert [k for k, v in report.items() if v is None] == ["a.geojson", "d.csv", "g.csv", "h.csv"]
    assert report["e.csv"] == "invalid CSV header or data row" and report["f.csv"] == "not readable CSV" and report["c.json"] == "not valid JSON"


def test_digests_hold_no_file_as_a_value(spark, tmp_path):
    bodies = {
        "large.bin": bytes(range(256)) * 12_000 + b"end", "zeros.csv": bytes(200_000), "marked.csv": b"\xef\xbb\xbfa;b\r\n" * 300, "packed.gz": b"not packed\n" * 300,
        "a b%20#\u00e4.json": b"{}", "below/large.bin": b"another of the same name" * 100,
    }
    (tmp_path / "below").mkdir()
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    expected = {name: (len(body), hashlib.sha256(body).hexdigest()) for name, body in bodies.items()}
    store = {"fs.viewfs.mounttable.digests.link./in": f"file://{tmp_path}", "fs.viewfs.impl.disable.cache": "true"}
    # readers refuse to hold more than this as one value; real files come above the 2 GB that one can have
    settings = {**store, "spark.sql.sources.binaryFile.maxLength": "1000"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        for root in (str(tmp_path), "viewfs://digests/in"):
            rows = IN.file_digests(spark, root).collect()
            assert {r["path"].split(f"{root}/")[1]: (r["bytes"], r["sha256"]) for r in rows} == expected and len(rows) == len(expected)
        lost = IN.file_digests(spark, str(tmp_path))
        (tmp_path / "large.bin").unlink()
        with pytest.raises(Exception, match="large.bin"):
            lost.collect()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_inventory_runs_and_lineage(spark, tmp_path):
    (tmp_path / "in").mkdir(), (tmp_path / "side").mkdir()
    body = b"payload"
    (tmp_path / "in" / "reg.csv").write_bytes(body)
    (tmp_path / "side" / "bnetza_charging_register_nrw.json").write_text('{"url":"https://example.org","licence":"CC"}')
    digests = IN.file_digests(spark, str(tmp_path / "in")).withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))
    consumed = spark.createDataFrame([("bnetza_ladesaeulenregister", "reg.csv")], "source_key string, path string")
    inputs = IN.inventory_inputs(consumed, digests, IN.read_sidecars(spark, str(tmp_path / "side")))
    row = inputs.first()
    assert (row["bytes"], row["sha256"]) == (len(body), hashlib.sha256(body).hexdigest()) and json.loads(row["provenance"])["licence"] == "CC"
    gone = spark.createDataFrame([("k", "absent.csv")], "source_key string, path string")
    with pytest.raises(Exception, match="missing"):
        IN.inventory_inputs(gone, digests, IN.read_sidecars(spark, str(tmp_path / "side"))).collect()
    runs = PV.record_run(PV.record_run(spark.createDataFrame([], "ingest_run_id string, recorded_at timestamp"), "r1", F.lit("2026-01-01").cast("timestamp")), "r2", F.lit("2026-02-01").cast("timestamp"))
    assert [r["ingest_run_id"] for r in PV.with_current(runs).where("is_current").collect()] == ["r2"]
    bound = PV.bind_inputs(inputs, "r2")
    assert PV.provenance_problems(runs, bound).where("violations > 0").count() == 0
    assert PV.provenance_problems(runs, PV.bind_inputs(inputs, "r1")).where("violations > 0").count() == 1
    catalog = spark.createDataFrame([("bnetza_charging_register_nrw", "cat", "required_input", "CC BY"), ("strassen_nrw_traffic_values", "cat2", "required_input", None)], "dataset_id string, source_url string, source_role string, license_note string")
    snapshots = spark.createDataFrame([("bnetza_ladesaeulenregister", datetime.date(2026, 4, 22), "n", "note", None)], "source_key string, snapshot_date date, source_name string, source_note string, recorded_at timestamp")
    lineage = {(r["layer"], r["id"]): r for r in PV.layer_lineage(PV.layer_table(spark), catalog, inputs, snapshots).collect()}
    own = lineage[("nrw_chargers", "bnetza_charging_register_nrw")]
    assert (own["source_url"], own["terms"], own["ingest_status"], own["source_date"]) == ("https://example.org", "CC", "recorded", "2026-04-22")
    road = lineage[("nrw_regional_roads", "strassen_nrw_traffic_values")]
    assert (road["ingest_status"], road["terms"], road["sha256"]) == ("not recorded in current successful ingest", "Terms not recorded in the source catalogue", None)
    cleared = PV.set_source_date(snapshots, "bnetza_ladesaeulenregister", snapshots.limit(0))
    assert cleared.count() == 0
    meta = PV.publish_metadata(spark.createDataFrame([(2, "b"), (1, "a")], "sort_order int, t string"), snapshots, runs, bound).first()
    assert [m["t"] for m in json.loads(meta["score_model"])] == ["a", "b"] and meta["ingest_run_id"] == "r2"


def layer(spark, n=5):
    return spark.range(n).select(F.format_string("s%03d", "id").alias("source_id"), F.lit(None).cast("string").alias("name"), G.point(F.col("id") + 6.5, F.lit(51.0)).alias("geom"))


def test_export_keeps_every_property_and_promotes_last(spark, tmp_path):
    root = str(tmp_path)
    manifest = EX.export_snapshot(spark, root, {"points": layer(spark)}, keys={"points": "source_id"})
    served = EX.current_generation(spark, root)
    assert manifest.first()["features"] == 5
    folder = f"{root}/generations/{served}/points"
    lines = [json.loads(r[0]) for r in spark.read.text(folder).collect()]
    assert sorted(f["properties"]["source_id"] for f in lines) == [f"s{i:03d}" for i in range(5)]
    assert lines[0]["properties"]["name"] is None and lines[0]["geometry"]["type"] == "Point"
    assert EX.written_files(spark, f"{root}/generations/{served}").agg(F.count("*")).first()[0] >= 1
    with pytest.raises(ValueError):
        EX.export_snapshot(spark, root, {"points": layer(spark).union(layer(spark, 1))}, keys={"points": "source_id"})
    assert EX.current_generation(spark, root) == served
    assert json.loads(EX.collection_json(layer(spark, 0), "source_id").first()[0])["features"] == []
    first = EX.build_manifest({"a": layer(spark)}).first()["content_sha256"]
    again = EX.build_manifest({"a": layer(spark).repartition(3).orderBy(F.desc("source_id"))}).first()["content_sha256"]
    assert first == again != EX.build_manifest({"a": layer(spark, 4)}).first()["content_sha256"]


def test_sync_and_pruning(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    after, diff = RL.sync_snapshot(old, new, ["k"])
    assert sorted(tuple(r) for r in diff.collect()) == [(1, "deleted"), (2, "updated"), (3, "unchanged"), (4, "inserted")]
    assert sorted(after.collect()) == sorted(new.collect())
    wide = old.withColumns({"empty": F.lit(None).cast("int"), "box": F.array("k")})
    assert RL.prune_columns(wide).columns == ["k", "v"]


def test_fast_share(spark):
    def share(rows):
        return MD.fast_share(spark.createDataFrame(rows, "chargers_total int, fast_chargers_total int, unknown_power_chargers_total int")).first()

    assert share([(2, 1, 0), (90, 9, 0)])["percent"] == pytest.approx(1000 / 92)
    assert [share(r)["reason"] for r in ([(0, 0, 0)], [(10, 4, 1)], [(10, 4, None)])] == ["zero_total", "incomplete_classification", "missing_counts"]
    change = MD.fast_share_change(
        spark.createDataFrame([(20, 4, 0, 25, 7, 0)], ", ".join(f"{p}_{c} int" for p in ("baseline", "scenario") for c in ("chargers_total", "fast_chargers_total", "unknown_power_chargers_total")))
    ).first()
    assert change["percentage_points"] == pytest.approx(8)


def proposal(i, request, minute, lon=7.2, points=4, top=50.0):
    at = datetime.datetime(2026, 1, 1, 0, minute)
    return (f"id-{i}", f" n{i} ", points, 150.0, top, f"0000000{request}-0000-4000-8000-000000000000", "me", at, lon, 51.2)


def test_feed_stores_each_request_once(spark, tmp_path):
    regions = W.districts(spark, [("DEA01", "1", "a", [W.box(7, 51, 7.5, 51.5)]), ("DEA02", "2", "b", [W.box(7.5, 51, 8, 51.5)])])
    index = build_index(regions, "nuts_code", "geom")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(rows):
        spark.createDataFrame(rows, FEED_SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        q = start_proposal_feed(spark, source, str(tmp_path / "cp"), target, index, once=True, files_per_trigger=1)
        q.awaitTermination()
        return sorted((r["id"], r["nuts_code"], r["name"]) for r in stored_proposals(spark, target).collect())

    arrive([proposal(1, 1, 1), proposal(2, 1, 2), proposal(3, 2, 1, lon=7.5), proposal(4, 3, 1, top=200.0)])
    assert run() == [("id-1", "DEA01", "n1")]
    # A retry of a stored request is ignored; a corrected one of a rejected request gets in.
    arrive([proposal(5, 1, 5), proposal(6, 3, 5, lon=7.7)])
    assert run() == [("id-1", "DEA01", "n1"), ("id-6", "DEA02", "n6")]
    assert run() == [("id-1", "DEA01", "n1"), ("id-6", "DEA02", "n6")]
    reasons = sorted(r["reason"] for r in spark.read.parquet(f"{target}/rejected").select("reason").collect())
    assert reasons == ["district", "duplicate_request", "duplicate_request", "max_point_power_range"]


def test_proposal_log(spark):
    log = spark.createDataFrame([("a", "insert", 1, "c1"), ("b", "insert", 1, "c2"), ("a", "delete", 2, "c1")], "id string, op string, at int, client_id string")
    assert [r["id"] for r in SC.current_proposals(log).collect()] == ["b"]
    gone = SC.delete_proposals(log, F.lit(3), owner="c2")
    assert SC.current_proposals(log.unionByName(gone)).count() == 0
    assert SC.delete_proposals(log, F.lit(3), owner="c1").count() == 0
    official = spark.range(5)
    assert [SC.station_total(official, log.limit(2), m).first()[0] for m in ("baseline", "scenario", "change")] == [5, 7, 2]
    assert SC.station_total(official, log, "scenario", available=False).first()[0] is None


def test_config_is_fixed():
    assert RegionConfig().percentiles == (0.05, 0.95) and RegionConfig().expected_regions == 53
