"""Large text documents cut into many splits against the standard library's readers."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from regionscore.sources import splits as SP
from regionscore.sources.features import read_feature_collection


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so that small files have many."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)


def messy_csv(sep: str, seed: int, newline: str = "\n") -> tuple[str, list[list[str]]]:
    rng = random.Random(seed)
    words = ["plain", "two words", 'a "quoted" word', "line\nbreak", "wide\r\nbreak", f"with{sep}separator", "", '"', '""', 'ends with "', "Straße", "€", "x" * 90]
    rows = [[f"id{i}", *(rng.choice(words) for _ in range(3))] for i in range(160)]
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator=newline)
    writer.writerow(["id", "a", "b", "c"])
    writer.writerows(rows)
    return out.getvalue(), rows


@pytest.mark.parametrize(("sep", "encoding", "newline"), [(",", "UTF-8", "\n"), (";", "windows-1252", "\r\n"), (";", "UTF-8", "\r\n")])
def test_csv_of_many_splits(spark, small_splits, tmp_path, sep, encoding, newline):
    for n in (1, 2):
        text, _ = messy_csv(sep, n, newline)
        (tmp_path / f"f{n}.csv").write_bytes(text.encode("cp1252" if encoding != "UTF-8" else "utf-8"))
    raw = SP.pieces(spark, str(tmp_path), "\n")
    assert raw.select("file", "block").distinct().count() > 20 and raw.rdd.getNumPartitions() > 20
    table = SP.read_csv(spark, str(tmp_path), ["id", "a", "b", "c"], sep=sep, encoding=encoding)
    got = [[r[c] or "" for c in ("id", "a", "b", "c")] for r in table.orderBy("ordinal").collect()]
    want = [r for n in (1, 2) for r in messy_csv(sep, n, newline)[1]]
    assert got == want


def test_a_quote_inside_a_plain_field_is_a_character(spark, small_splits, tmp_path):
    lines = [f'{i};5" pipe;"open\n{"y" * 120}"' if i % 3 else f'{i};say "hi" twice;""' for i in range(60)]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    got = SP.read_csv(spark, str(tmp_path), ["i", "a", "b"], sep=";", skip_first=False).orderBy("ordinal").collect()
    want = list(csv.reader(io.StringIO("\n".join(lines)), delimiter=";"))
    assert [[r.i, r.a, r.b] for r in got] == want


def test_one_long_quoted_field_over_many_splits(spark, small_splits, tmp_path):
    field = "\n".join(f"line {i}, with commas" for i in range(300))
    (tmp_path / "f.csv").write_text(f'id,a\n1,"{field}"\n2,b\n3')
    got = SP.read_csv(spark, str(tmp_path), ["id", "a"]).orderBy("ordinal").collect()
    assert [(r.id, r.a) for r in got] == [("1", field), ("2", "b"), ("3", None)]
    (tmp_path / "f.csv").write_text("")
    assert SP.read_csv(spark, str(tmp_path), ["id", "a"]).collect() == []


def collection(seed: int, n: int) -> dict:
    rng = random.Random(seed)
    odd = ['brace } in text', 'open { and [', 'quote " here', "back\\slash", '"features": [', "Straße", "", "}\\", '\\"}']
    features = [
        {
            "type": "Feature",
            "id": f"{seed}/{i}",
            "properties": {"name": rng.choice(odd), "nested": json.dumps({"features": [{}, {"a": rng.choice(odd)}]}), "list": None},
            "geometry": {"type": "LineString", "coordinates": [[rng.random() * 9, i / 7] for _ in range(rng.randrange(2, 30))]},
        }
        for i in range(n)
    ]
    head = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "before": [{"features": [{"no": 1}]}, {"b": {}}]}
    return {**head, "features": features, "after": [{"type": "Feature", "id": "not one"}], "bbox": [0, 1]}


@pytest.mark.parametrize("indent", [None, 2])
def test_one_collection_in_many_splits(spark, small_splits, tmp_path, indent):
    documents = [collection(1, 40), collection(2, 0), collection(3, 25)]
    for i, d in enumerate(documents):
        text = json.dumps(d, indent=indent, ensure_ascii=False)
        (tmp_path / f"f{i}.json").write_text(("﻿" if i == 0 else "") + text + "\n", encoding="utf-8")
    found = SP.collection_features(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [json.loads(r.feature) for r in found] == [f for d in documents for f in d["features"]]
    rows = read_feature_collection(spark, str(tmp_path), ["name"]).collect()
    want = sorted((f["id"], f["properties"]["name"], f["geometry"]["coordinates"]) for d in documents for f in d["features"])
    assert sorted((r["id"], r["properties"]["name"], json.loads(r["geometry"]["coordinates"])) for r in rows) == want


@pytest.mark.parametrize("text", ['{"type":"Feature","id":"a"}', '{"type":"FeatureCollection","other":[]}', '{"a":{"type":"FeatureCollection","features":[]}}', '{"features":[]}'])
def test_other_documents_are_refused(spark, tmp_path, text):
    (tmp_path / "f.json").write_text(text)
    with pytest.raises(ValueError, match="not a GeoJSON"):
        SP.collection_features(spark, str(tmp_path))


def test_states_compose_over_any_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.random() < 0.4, rng.random() < 0.6) for i in range(200)]
    got = SP.states(spark.createDataFrame(rows, "at int, a boolean, b boolean").withColumn("p", F.lit(1)), ["p"], "at").orderBy("at").collect()
    for s in (0, 1):
        state = bool(s)
        for r in got:
            assert r[f"s{s}"] == state
            state = r.b if state else r.a
