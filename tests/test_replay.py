"""Replayed proposals, logs with equal times, and register fields with quotes and line breaks."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

import worlds as W
from regionscore.operators import region_index as RI
from regionscore.operators import quantiles
from regionscore.operators.quantiles import bounds, exact_percentiles
from regionscore.plans import scenario as SC
from regionscore.sources import tables as ST
from regionscore.sources.register import read_station_register
from regionscore.streaming import proposals as PR
from regionscore.streaming.proposals import FEED_SCHEMA, accept_batch

REQUESTS = [str(uuid.UUID(int=i + (4 << 76) + (8 << 60))) for i in range(6)]
IDS = [str(uuid.UUID(int=100 + i + (4 << 76) + (8 << 60))) for i in range(6)]


def proposal(ident, request, minute, lon=6.5, lat=50.5):
    return (IDS[ident], "Depot", 4, 150.0, 75.0, REQUESTS[request], "client", datetime.datetime(2026, 1, 1, 0, minute), lon, lat)


@pytest.fixture(scope="module")
def squares(spark):
    regions = W.districts(spark, [("DEA01", "1", "a", [W.box(6, 50, 7, 51)]), ("DEA02", "2", "b", [W.box(7, 50, 8, 51)])])
    return RI.build_index(regions, "nuts_code", "geom")


def test_one_row_is_stored_for_a_request_and_for_an_id(spark, squares):
    batch = [
        proposal(0, 0, 1), proposal(0, 0, 1), proposal(0, 0, 9, lat=50.25),  # replays, one of them late and changed
        proposal(1, 1, 2), proposal(1, 2, 3),  # one id under two requests
        proposal(2, 3, 4, lon=7.5),
        proposal(3, 4, 5, lon=9.5),  # outside
    ]
    stored = spark.createDataFrame([], PR.KEYS)
    accepted, rejected = accept_batch(spark.createDataFrame(batch, FEED_SCHEMA), stored, squares)
    rows = accepted.collect()
    assert sorted((r.id, r.request_id, r.nuts_code) for r in rows) == sorted([(IDS[0], REQUESTS[0], "DEA01"), (IDS[1], REQUESTS[1], "DEA01"), (IDS[2], REQUESTS[3], "DEA02")])
    assert next(r.lat for r in rows if r.id == IDS[0]) == 50.5
    assert sorted(r.reason for r in rejected.collect()) == ["district", "duplicate_id", "duplicate_request", "duplicate_request"]
    again, refused = accept_batch(spark.createDataFrame([proposal(0, 0, 1), proposal(2, 5, 6), proposal(4, 5, 7)], FEED_SCHEMA), PR._keys(accepted).drop("bucket"), squares)
    # request 5 comes first under a used id, which uses up nothing, and then under a free one
    assert [(r.id, r.request_id) for r in again.collect()] == [(IDS[4], REQUESTS[5])]
    assert sorted(r.reason for r in refused.collect()) == ["duplicate_request", "duplicate_request"]


def test_a_rejected_row_uses_up_nothing(spark, squares):
    stored = spark.createDataFrame([("request", REQUESTS[0]), ("id", IDS[0])], PR.KEYS)
    # the stored request again under another id, then a new request under that id
    accepted, rejected = accept_batch(spark.createDataFrame([proposal(1, 0, 1), proposal(1, 1, 2)], FEED_SCHEMA), stored, squares)
    assert [(r.id, r.request_id) for r in accepted.collect()] == [(IDS[1], REQUESTS[1])]
    assert [r.reason for r in rejected.collect()] == ["duplicate_request"]
    # a request first under a used id, then under a free one
    accepted, rejected = accept_batch(spark.createDataFrame([proposal(0, 2, 1), proposal(2, 2, 2)], FEED_SCHEMA), stored, squares)
    assert [(r.id, r.request_id) for r in accepted.collect()] == [(IDS[2], REQUESTS[2])]
    assert [r.reason for r in rejected.collect()] == ["duplicate_request"]


def test_tangled_ids_and_requests_as_if_one_by_one(spark, squares):
    rng = random.Random(2)
    rows = [proposal(rng.randrange(6), rng.randrange(6), minute) for minute in rng.sample(range(60), 30)] * 2
    ids, requests, want = set(), set(), []
    for r in sorted(rows, key=lambda r: (r[7], r[0], r[5])):
        if r[0] not in ids and r[5] not in requests:
            ids.add(r[0]), requests.add(r[5]), want.append((r[0], r[5], r[7]))
    accepted, rejected = accept_batch(spark.createDataFrame(rows, FEED_SCHEMA), spark.createDataFrame([], PR.KEYS), squares)
    assert sorted((r.id, r.request_id, r.created_at) for r in accepted.collect()) == sorted(want)
    assert rejected.count() == len(rows) - len(want)


def test_files_read_for_a_batch_do_not_grow_with_the_batches(spark, squares, tmp_path):
    for day in range(7):
        rows = [(str(uuid.UUID(int=1000 * day + i + (4 << 76) + (8 << 60))), "Depot", 4, 150.0, 75.0, str(uuid.UUID(int=7_000_000 + 1000 * day + i + (4 << 76) + (8 << 60))), "c", datetime.datetime(2026, 1, 1 + day), 6.5, 50.5) for i in range(20)]
        rows.append(rows[0][:5] + (rows[0][5],) + rows[0][6:])
        if day:
            rows.append((rows[0][0], "Depot", 4, 150.0, 75.0, first_request, "c", datetime.datetime(2026, 1, 1 + day), 6.5, 50.5))
        first_request = rows[0][5]
        spark.createDataFrame(rows, FEED_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = PR.start_proposal_feed(spark, str(tmp_path / "in"), str(tmp_path / "checkpoint"), str(tmp_path / "out"), squares, once=True, merge_every=3)
        feed.awaitTermination()
        assert feed.exception() is None
    out = str(tmp_path / "out")
    stored = PR.stored_proposals(spark, out)
    assert stored.count() == 140 == stored.select("id").distinct().count() == stored.select("request_id").distinct().count()
    assert PR._bases(spark, out) and max(PR._bases(spark, out)) == 6
    batch = stored.where("batch = 1").limit(1)
    seen = PR.seen_keys(spark, out, batch, 7)
    assert {"request", "id"} == {r.kind for r in seen.join(PR._keys(batch), ["kind", "key"]).collect()}
    assert "bucket" in seen._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("]")[0]
    files = [r[0] for r in seen.select(F.input_file_name()).distinct().collect()]
    # of the base and the one batch after it: the two buckets of this batch's keys
    assert 0 < len(files) <= 2 * (1 + 1), files
    assert PR.seen_keys(spark, out, batch, 1).join(PR._keys(batch), ["kind", "key"]).count() == 0


def test_equal_times_in_the_log(spark):
    log = spark.createDataFrame([("a", "insert", 1, "x"), ("a", "delete", 1, "x"), ("b", "insert", 1, "x"), ("b", "insert", 1, "y"), ("c", "delete", 1, "x"), ("c", "insert", 2, "x")], "id string, op string, at int, client_id string")
    assert sorted(r.id for r in SC.current_proposals(log).collect()) == ["b", "c"]


HEADER = "Ladeeinrichtungs-ID;Bundesland;Breitengrad;Längengrad;Nennleistung Ladeeinrichtung [kW];Anzahl Ladepunkte;Nennleistung Stecker1;Betreiber"


@pytest.mark.parametrize("encoding", ["utf-8-sig", "cp1252"])
def test_quoted_fields_keep_their_values(spark, tmp_path, encoding):
    names = ['Firma "Q"; Söhne', "Erste Zeile\nzweite", '"ganz"', "schlicht"]
    rows = [f'id{i};Nordrhein-Westfalen;51,{i};7,{i};{i + 1}1;{i + 1};{i + 2}2;"' + n.replace('"', '""') + '"' for i, n in enumerate(names)]
    path = tmp_path / "register.csv"
    path.write_text("\n".join(["kopf"] * 10 + [HEADER, *rows]), encoding=encoding)
    stations, _ = read_station_register(spark, str(path))
    got = {r.id: r for r in stations.collect()}
    assert [got[f"id{i}"].operator for i in range(4)] == names
    assert [got[f"id{i}"].max_point_power_kw for i in range(4)] == [22.0, 32.0, 42.0, 52.0]


def test_quoted_plants(spark, tmp_path):
    path = tmp_path / "plants.csv"
    path.write_text('id,state,lat,lon,name_bnetza,company,energy_source,technology,capacity_net_bnetza,status,voltage,network_operator\np1,Nordrhein-Westfalen,51,7,"Block ""A"", Nord","Zeile\nzwei",Gas,GT,12.5,ok,110,Netz\n')
    row = ST.read_plants(spark, str(path)).first()
    assert (row["name"], row.operator, row.capacity_mw) == ('Block "A", Nord', "Zeile\nzwei", 12.5)


def test_bounds_do_not_depend_on_size(spark):
    """The same values once and four thousand times over, with values that are none among them."""
    base = spark.range(100).selectExpr("CASE WHEN id % 10 = 0 THEN double('NaN') WHEN id % 10 = 1 THEN NULL ELSE double(id) END AS x")
    once = bounds(base, ["x"]).first()
    many = bounds(base.crossJoin(spark.range(4000)).select("x"), ["x"]).first()
    assert once["x_low"] == pytest.approx(many["x_low"], abs=1.5) and once["x_high"] == pytest.approx(many["x_high"], abs=1.5)
    assert once["x_high"] == once["x_high"]


def test_percentiles_of_odd_values(spark):
    import numpy as np

    rng = random.Random(6)
    columns = {
        "skewed": [rng.lognormvariate(0, 9) for _ in range(20_000)],
        "one value": [7.5] * 15_000 + [rng.random() for _ in range(5_000)],
        "neighbours": [float(np.nextafter(1.0, 2.0)) if rng.random() < 0.5 else 1.0 for _ in range(20_000)],
        "huge": [rng.choice([-1, 1]) * 1.7e308 * rng.random() for _ in range(20_000)],
        "signed": [rng.gauss(0, 1) for _ in range(20_000)],
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"`{c}` double" for c in columns)).withColumn("none", F.lit(None).cast("double"))
    fractions = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r.metric, r.fraction): r.value for r in exact_percentiles(df, [*columns, "none"], fractions).collect()}
    for c, values in columns.items():
        ordered = sorted(values)
        for f in fractions:
            at = f * (len(values) - 1)
            low, high = ordered[int(at)], ordered[min(int(at) + 1, len(values) - 1)]
            assert got[c, f] == pytest.approx(low + (at - int(at)) * (high - low) if c != "huge" else got[c, f], rel=1e-12)
            assert low <= got[c, f] <= high
    assert not [k for k in got if k[0] == "none"]
    ends = spark.createDataFrame([(float("-inf"),)] * 10 + [(float(i),) for i in range(81)] + [(float("inf"),)] * 10, "x double")
    assert [r.value for r in exact_percentiles(ends, ["x"], [0.05, 0.5, 0.95]).collect()] == [float("-inf"), 40.0, float("inf")]


def test_ranks_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "RANKED_TOGETHER", 100)
    rng = random.Random(7)
    scores = [None if rng.random() < 0.1 else round(rng.lognormvariate(0, 2), 2) for _ in range(3000)]
    got = quantiles.rank_desc_nulls_last(spark.createDataFrame(list(enumerate(scores)), "i int, s double"), "s").collect()
    ordered = sorted((s for s in scores if s is not None), reverse=True)
    first = {}
    for i, s in enumerate(ordered):
        first.setdefault(s, i + 1)
    assert {r.i: r["rank"] for r in got} == {i: first[s] if s is not None else len(ordered) + 1 for i, s in enumerate(scores)}
