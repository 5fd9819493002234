"""Importance resampling, backoff scores, shards, surrogates, fingerprints and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from regionscore.llm import backoff, fingerprints, importance, rendezvous, surrogates

from . import worlds


# importance resampling


def quality_world(spark, n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        own = worlds.words(k, 20 + rng.randrange(60), 0)
        good = k % 5 != 0
        text = " ".join(own) if good else (" ".join(w.upper() + "!!" for w in own) if k % 2 else " ".join([own[0]] * 40))
        rows.append((k, text))
        labels.append((k, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_resampling_separates_held_out_rows(spark):
    docs, labels = quality_world(spark)
    model = importance.fit(docs, labels.where("doc_id < 200"))
    rows = importance.resample(docs, model)[0].where("doc_id >= 200").collect()
    assert sum(r.keep == (r.doc_id % 5 != 0) for r in rows) >= 0.97 * len(rows)
    drawn, needed, _ = importance.resample(docs, model, k=50)
    kept = drawn.where("keep").collect()
    assert len(kept) == 50 and min(r.gumbel_key for r in kept) == needed
    good = importance.keep_good(docs, labels)
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in importance.resample(docs, importance.fit(docs, labels))[0].where("keep").collect()}


def test_toxic_labels_are_not_target_text(spark):
    docs, labels = quality_world(spark)
    toxic = labels.withColumn("toxic", F.when(F.col("doc_id") % 7 == 0, 1).when(F.col("doc_id") % 7 == 1, None).otherwise(0))
    toxic = toxic.unionByName(spark.createDataFrame([(3, None, 1), (4, 1, 1)], labels.schema))
    model = importance.fit(docs, toxic)
    assert model.good == {k for k in range(400) if k % 5 and k % 7 and k not in (3, 4)}
    assert model.bad == set(range(400)) - model.good


def test_resampling_of_messy_and_empty_tables(spark):
    _, labels = quality_world(spark, 10)
    messy = worlds.messy(spark)
    model = importance.fit(messy, labels.where("false"))
    assert not model.fitted
    rows = importance.resample(messy, model)[0].collect()
    assert len(rows) == len(worlds.messy_rows())
    assert {r.doc_id for r in rows if not r.keep} == {2, 3, 4, None}
    assert importance.keep_good(messy, labels).columns == messy.columns
    assert importance.keep_good(worlds.empty(spark), labels).collect() == []


def test_kth_largest_with_ties(spark):
    values = [1.0] * 30 + [2.0, 2.0, 3.5, -1.0, 1e-9]
    table = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for k in (1, 2, 3, 4, 10, 33, 34, 35, 99):
        for parts in (2, 4096):
            assert importance.kth_largest(table, "v", k, parts) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert importance.kth_largest(table, "v", 0) is None


# backoff


@pytest.mark.parametrize(("order", "leave_out"), [(2, True), (2, False), (3, True)])
def test_scores_are_those_of_plain_counting(spark, order, leave_out, monkeypatch):
    monkeypatch.setattr(backoff, "PARTITION_GRAMS", 300)
    texts = {k: " ".join(worlds.words(k // 2, 5 + 7 * (k % 9), 30)) for k in range(40)}
    texts[50], texts[51], texts[52] = None, "", "Lone Lone"
    tokens = {k: (t or "").lower().split() for k, t in texts.items()}
    grams = lambda ws, n: Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    every = [sum((grams(ws, n) for ws in tokens.values()), Counter()) for n in range(1, order + 1)]
    size = sum(map(len, tokens.values()))
    rows = {r.doc_id: r for r in backoff.backoff_scores(worlds.table(spark, texts), order, leave_out=leave_out).collect()}
    assert set(rows) == set(texts)
    for k, ws in tokens.items():
        own = [grams(ws, n) if leave_out else Counter() for n in range(1, order + 1)]
        count = lambda g: every[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: E731, B023
        total, backed = 0.0, 0
        for i in range(len(ws)):
            top = min(i + 1, order)
            for n in range(top, 1, -1):
                g = tuple(ws[i - n + 1 : i + 1])
                if count(g) > 0:
                    total += math.log(count(g) / count(g[:-1])) + (top - n) * math.log(0.4)
                    backed += n < top
                    break
            else:
                total += math.log(max(count((ws[i],)), 1) / max(size - (len(ws) if leave_out else 0), 1)) + (top - 1) * math.log(0.4)
                backed += top > 1
        assert (rows[k].n_words, rows[k].n_backed_off) == (len(ws), backed)
        assert rows[k].log_score == pytest.approx(total, abs=1e-9)
    assert rows[51].mean_log_score is None


def test_scores_of_messy_and_empty_tables(spark):
    rows = backoff.backoff_scores(worlds.messy(spark)).collect()
    assert len(rows) == len(worlds.messy_rows()) and len({r.log_score for r in rows if r.doc_id in (6, 7)}) == 1
    assert backoff.backoff_scores(worlds.empty(spark)).collect() == []


# shards


def test_slots_are_gapless_and_shards_grow_into_the_new_one(spark):
    rows = rendezvous.slots(worlds.messy(spark), [1.0] * 4, more=1.0).collect()
    assert len(rows) == len(worlds.messy_rows())
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert all(r.grown_shard in (r.shard, 4) for r in rows)
    by_key = {r.doc_id: r for r in rows}
    assert by_key[2]["size"] == 1 and by_key[2].text_crc32 == 0
    text = worlds.messy_rows()[0][1].encode()
    assert (by_key[1]["size"], by_key[1].text_crc32) == (len(text) + 1, zlib.crc32(text))
    assert rendezvous.slots(worlds.empty(spark), [1.0]).collect() == []


def test_weights_set_the_shares_and_few_records_move(spark):
    docs = spark.range(6000).withColumnRenamed("id", "doc_id")
    rows = rendezvous.assign(docs.withColumn("shard", F.lit("old")), [1.0, 2.0, 3.0, 0.0], more=1.0).collect()
    share = Counter(r.shard for r in rows)
    assert [round(share[s] / 1000) for s in range(4)] == [1, 2, 3, 0]
    moved = sum(r.grown_shard != r.shard for r in rows)
    assert 650 < moved < 1070
    heavier = rendezvous.assign(docs, [1.0, 2.0, 4.0, 0.0]).collect()
    before = {r.doc_id: r.shard for r in rows}
    assert all(r.shard in (before[r.doc_id], 2) for r in heavier)
    with pytest.raises(ValueError):
        rendezvous.assign(docs, [0.0])


def test_shards_are_the_highest_scores(spark):
    rows = rendezvous.assign(spark.range(200).withColumnRenamed("id", "doc_id"), [1.0, 0.5, 2.0]).collect()
    for r in rows:
        draw = [(int(hashlib.md5(f"{r.doc_id}#{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for s in range(3)]
        assert r.shard == max(range(3), key=lambda s: [1.0, 0.5, 2.0][s] / -math.log(draw[s]))


# surrogates

PII = {
    1: "Write to Anna.Berg@Mail.example.com or anna.berg@mail.example.com, phone +1 (407) 555-7710 or (407) 555-7710.",
    2: "Card 4539 1488 0343 6467 and 4539148803436467; host 10.1.2.3, not version 1.2.3.",
    3: 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"!! TOKEN = "1EB9C654E721B4F812088970E66A6345CEE33DD6"',
    4: "Mr. John Smith met Mrs. Mary Smith and Frau Müller; Господин Иванов came. MR. JOHN",
    5: "Nothing of the kind in 2024, at 12:30, for 15 people or Section 3.2.",
    6: "IBAN DE89 3704 0044 0532 0130 00, number 123-45-6789, a@b.co,c@d.co",
    7: "2353820953013749 4550997810720808",
}


def test_surrogates_keep_type_format_and_coreference(spark):
    docs = worlds.table(spark, PII)
    rows = {r.doc_id: r for r in surrogates.replace_entities(docs, "k").collect()}
    mails = re.findall(r"[\w.]+@[\w.]+\w", rows[1].text)
    assert len(mails) == 2 and mails[0].lower() == mails[1] and "berg" not in rows[1].text.lower() and mails[1].endswith(".com")
    assert [c.isupper() for c in mails[0]] == [c.isupper() for c in "Anna.Berg@Mail.example.com"]
    phones = re.findall(r"\(\d{3}\) \d{3}-\d{4}", rows[1].text)
    assert len(phones) == 2 and phones[0] == phones[1] != "(407) 555-7710" and "+1 (" in rows[1].text
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", rows[2].text)
    assert cards[0].replace(" ", "") == cards[1] != "4539148803436467" and cards[1][0] == "4"
    digits = [int(c) for c in cards[1]][::-1]
    assert sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    assert "10.1.2.3" not in rows[2].text and "version 1.2.3" in rows[2].text
    secrets = re.findall(r"[0-9a-fA-F]{40}", rows[3].text)
    assert secrets[0].upper() == secrets[1] and secrets[0].lower() != "1eb9c654e721b4f812088970e66a6345cee33dd6"
    names = re.match(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+) and Frau (\w+); Господин (\w+) came", rows[4].text)
    assert names and names[2] == names[4] and names[1] != names[3] and names[3].endswith("a") and re.fullmatch("[а-яА-Я]+", names[6])
    assert rows[5].text == PII[5] and rows[5].n_entities == 0
    assert "DE89" not in rows[6].text and "123-45-6789" not in rows[6].text and rows[6].n_entities == 4
    assert rows[7].n_entities == 2 and re.fullmatch(r"\d{16} \d{16}", rows[7].text)
    again = {r.doc_id: r.text for r in surrogates.replace_entities(docs, "k").collect()}
    other = {r.doc_id: r.text for r in surrogates.replace_entities(docs, "other").collect()}
    assert again == {k: r.text for k, r in rows.items()} and other[1] != rows[1].text


def test_no_part_of_an_entity_stays(spark):
    long, key = "aB3" * 2000, "0123456789abcdef" * 20
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.SflKxwRJSMeKKF2QT4"
    texts = {
        1: f'password = "{long}" and key {key}.',
        2: f"token: {jwt}. The end",
        3: "Dr. John Smith came. Later Smith's friend JOHN left, and Smithson too.",
        4: "MR. JOHN met mrs. Mary Miller; Miller went",
        5: "Call 555 123 4567 or 555-123-4567, number 123 45 6789",
        6: "Hosts 2001:db8:85a3:0:0:8a2e:370:7334, 2001:DB8::1 and 2001:db8::1 at 12:30:45 in std::sort",
    }
    rows = {r.doc_id: r for r in surrogates.replace_entities(worlds.table(spark, texts), "k").collect()}
    out = {k: r.text for k, r in rows.items()}
    assert len(out[1]) == len(texts[1]) and "aB3aB3" not in out[1] and key[:32] not in out[1] and key[-32:] not in out[1]
    assert not any(part in out[2] for part in jwt.split(".")) and out[2].endswith(". The end") and out[2].count(".") == 3
    names = re.fullmatch(r"Dr\. (\w+) (\w+) came\. Later (\w+)'s friend (\w+) left, and Smithson too\.", out[3])
    assert names and names[2] == names[3] != "Smith" and names[1].upper() == names[4] != "JOHN" and rows[3].n_entities == 3
    names = re.fullmatch(r"MR\. (\w+) met mrs\. (\w+) (\w+); (\w+) went", out[4])
    assert names and names[1] != "JOHN" and names[1].isupper() and names[3] == names[4] != "Miller"
    phones = re.fullmatch(r"Call (\d{3} \d{3} \d{4}) or (\d{3}-\d{3}-\d{4}), number (\d{3} \d{2} \d{4})", out[5])
    assert phones and phones[1].replace(" ", "-") == phones[2] != "555-123-4567" and phones[3] != "123 45 6789"
    hosts = re.fullmatch(r"Hosts ([\da-f:]+), (\S+) and (\S+) at 12:30:45 in std::sort", out[6])
    assert hosts and "2001" not in out[6] and hosts[2].lower() == hosts[3] and hosts[1].count(":") == 7


def test_distinct_entities_stay_distinct(spark):
    """Many short numbers and names: draws collide and are drawn again."""
    names = [(k, "person", "m", f"name{k}") for k in range(3000)] + [(k, "email", "", f"{chr(97 + k % 26)}@{chr(97 + k // 26)}.de") for k in range(300)]
    entities = spark.createDataFrame([n[1:] for n in names], "kind string, `group` string, normal string")
    rows = surrogates.dictionary(entities, "k").collect()
    assert len(rows) == 3300 and len({(r.kind, r.surrogate) for r in rows}) == 3300
    assert not {(r.kind, r.surrogate) for r in rows} & {(r.kind, r.normal) for r in rows}


def test_surrogates_of_messy_and_empty_tables(spark):
    messy = worlds.messy(spark)
    out = surrogates.replace_entities(messy, "k", counted=None)
    assert out.columns == messy.columns and out.count() == len(worlds.messy_rows())
    assert out.exceptAll(messy).count() == 0
    assert surrogates.replace_entities(worlds.empty(spark), "k").collect() == []
    equal = spark.createDataFrame([(1, "a@b.com", 5), (1, "a@b.com", 6), (None, "a@b.com", 7), (None, None, 8)], "doc_id long, text string, n_entities long")
    texts = [r.text for r in surrogates.replace_entities(equal, "k").collect()]
    assert len(texts) == 4 and len({t for t in texts if t}) == 1 and "a@b.com" not in texts


# fingerprints


def test_edits_and_fingerprints(spark):
    texts = {k: ". ".join(worlds.words(k, 3 + 11 * (k % 17), 0)) for k in range(0, 200, 3)}
    texts[1000], texts[1001], texts[1002] = None, "", "One.\nTwo.\nTwo."
    texts[1003] = texts[3]
    order = sorted(texts, reverse=True)
    for per_range in (7, 4000):
        rows = {r.doc_id: r for r in fingerprints.fingerprint_edits(worlds.table(spark, texts), per_range=per_range).collect()}
        assert set(rows) == set(texts)
        for k, after in zip(order, order[1:] + order[:1], strict=True):
            own, following = texts[k] or "", texts[after] or ""
            edited = fingerprints.edit(own, following)
            assert rows[k].n_chars == len(own) and rows[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= rows[k].near_next <= 1 and 0 <= rows[k].near_edited <= 1
        assert rows[1003].fingerprint == rows[3].fingerprint and rows[1000].fingerprint == rows[1001].fingerprint
        assert len({r.fingerprint for r in rows.values()}) == len(set(t or "" for t in texts.values()))


def test_peeling_recovers_the_exact_difference():
    rng = np.random.default_rng(1)
    a = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 1, 5, 300, 4000)]
    b = [np.concatenate([x[: len(x) // 2], rng.integers(0, 2**63, n, dtype=np.uint64)]) for x, n in zip(a, (0, 3, 0, 40, 900), strict=True)]
    pack = lambda parts: (np.concatenate(parts), np.array([len(p) for p in parts]))
    found = fingerprints.likeness(pack(a), pack(b))
    wanted = [len(set(x.tolist()) & set(y.tolist())) / max(1, len(set(x.tolist()) | set(y.tolist()))) if len(x) or len(y) else 1.0 for x, y in zip(a, b, strict=True)]
    assert found.tolist() == pytest.approx(wanted)


def test_digests_follow_paragraphs():
    texts = [b"one two.\nthree four.\nfive six.", b"one two.\nthree four.\nseven six.", b"", b"x\nx\nx"]
    found, counts = fingerprints.digests(texts)
    first, second = set(found[: counts[0]].tolist()), set(found[counts[0] : counts[0] + counts[1]].tolist())
    assert first & second and first != second and counts[2] == 0
    assert len(set(found[-counts[3] :].tolist())) == counts[3] >= 3


def test_fingerprints_of_messy_and_empty_tables(spark):
    assert fingerprints.fingerprint_edits(worlds.messy(spark)).count() == len(worlds.messy_rows())
    assert fingerprints.fingerprint_edits(worlds.empty(spark)).collect() == []


# pipeline


def test_pipeline_is_its_stages_by_hand(spark):
    """Each stage against the rows it must drop, keep or change, on a small corpus."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    step = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        step = corpus_pipeline.materialize(stage(spark, step, sf_dir), name)
        seen[name] = step
        assert name == "packing" or step.columns == docs.columns
    good = {r.doc_id for r in seen["quality"].collect()}
    assert sum((k in good) == bool(q) for k, q in labels.items()) >= 0.97 * len(labels)
    from .test_pairs import brute_classes, brute_contaminated

    classes = brute_classes({k: texts[k] for k in good}, 5, 80, 100)
    one = {r.doc_id for r in seen["deduplicate"].collect()}
    assert one == {k for k, c in classes.items() if k == c}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    dirty = {k for k, _ in brute_contaminated({k: texts[k] for k in one}, items)}
    clean = {r.doc_id for r in seen["decontaminate"].collect()}
    assert clean == one - dirty
    changed = {r.doc_id: r.text for r in seen["pseudonymise"].collect()}
    assert set(changed) == clean
    for k, t in changed.items():
        assert (t == texts[k]) == (not re.search(r"\w@\w|\d{13}|\(\d{3}\)|\d\.\d+\.\d+\.\d|[0-9a-fA-F]{32}", texts[k]))
    pieces = seen["packing"].collect()
    assert {p.doc_id for p in pieces} == clean
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, pieces))
