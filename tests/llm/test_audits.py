"""Source divergence, WARC captures and token alignment against plain ways to the same results."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from regionscore.llm import alignment, divergence, warc
from regionscore.llm.common import new_path
from tests.llm.worlds import empty, messy, messy_rows, words

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# ---- divergence


def plain_audit(rows, least_docs, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = term.findall((text or "").translate(lower))
        counts[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    out = set()
    for lang in held:
        kept = {t for t, n in held[lang].items() if n >= least_docs}
        groups = {s: {t: n for t, n in c.items() if t in kept} for (k, s), c in counts.items() if k == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def share(c, kept=kept):
            size = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c.get(t, 0) + 2) // size for t in kept}

        shares, language = {s: share(c) for s, c in groups.items()}, share(whole)
        for s, p in shares.items():
            far = [(sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in kept), o) for o, q in shares.items() if o != s]
            marks = [((p[t] - language[t]) ** 2 // (p[t] + language[t]), t) for t, n in groups[s].items() if n and p[t] > language[t]]
            for part, found in (("pair", far), ("term", marks)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < top}
    return out


def audit_rows():
    rng = random.Random(3)
    rows = []
    for i in range(160):
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(12)}"
        frequent = ["the"] * rng.randrange(40) + ["Of"] * rng.randrange(9)
        rows.append((rng.choice(["en", "de", None]), source, " ".join(frequent + words(i, rng.randrange(60), 90)) + " Straße ÄB9cd"))
    return [*rows, ("xx", "lonely", "once only"), ("xx", None, None), ("xx", "", ""), (None, None, " 12 "), ("en", "bare", None)]


@pytest.mark.parametrize(("blocks", "tile"), [(None, None), (((8, 4), (2, 7), (0, 130)), 3)])
def test_divergence_equals_plain_counting(spark, monkeypatch, blocks, tile):
    if blocks:
        monkeypatch.setattr(divergence, "BLOCK_TERMS", blocks)
        monkeypatch.setattr(divergence, "TILE_SOURCES", tile)
    rows = audit_rows()
    docs = spark.createDataFrame([(l, s, t, 1, "x") for l, s, t in rows], "lang string, source string, text string, n int, term string").repartition(5)
    got = {tuple(r) for r in divergence.divergence_audit(docs, least_docs=5).collect()}
    assert got == plain_audit(rows, 5)
    assert ("xx", "lonely", "pair", "", 0, 1) in got  # a language that keeps no term


def test_divergence_of_odd_tables(spark):
    docs = messy(spark).withColumn("source", F.col("shard"))
    got = {tuple(r) for r in divergence.divergence_audit(docs, least_docs=1).collect()}
    assert got == plain_audit([(r[2], r[4], r[1]) for r in messy_rows()], 1)
    assert divergence.divergence_audit(empty(spark).withColumn("source", F.col("shard"))).collect() == []


def test_shares_of_counts_beyond_a_long_product(spark):
    row = spark.createDataFrame([(6 * 10**17, 9 * 10**17, 5)], "n long, t long, v long").select(divergence._share("n", "t", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (6 * 10**17 + 2) // (9 * 10**17 + 10)


# ---- captures


def test_tree_of_losers_gives_all_keys_in_order():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 7, 8, 33):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        order = list(warc.merged(runs))
        assert [runs[r][i] for r, i in order] == sorted(x for run in runs for x in run)
        assert len(set(order)) == len(order)
        assert order == sorted(order, key=lambda o: (runs[o[0]][o[1]], *o))  # equal keys by run


def test_url_keys():
    assert warc.url_key("http://www.B.example.com:80/Path?b=2&a=1#top") == "com,example,b)/path?a=1&b=2"
    assert warc.url_key("https://b.example.com/path?a=1&b=2") == "com,example,b)/path?a=1&b=2"
    assert warc.url_key("https://b.example.com:8443") == "com,example,b:8443)/"
    assert warc.url_key(None) == "" and warc.url_key("no url") == "no url" and warc.url_key("http://x:y/") == "http://x:y/"


def page_rows():
    rng = random.Random(11)
    rows = [(i, f"http://h{rng.randrange(5)}.example.org/p{rng.randrange(30)}?z=1", f"<p>page {i} " + "x " * rng.randrange(400)) for i in range(200)]
    rows += [(1000 + i, "http://hot.example.org/", "<p>one text for all</p>") for i in range(90)]
    return [*rows, (5000, None, None), (5001, "", ""), (5002, "http://a b\r\nc/ü%41", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (5003, "x", "<p>one text for all</p>"), (None, "n", "no key"), (None, None, "no key"), (7, "twice", "<p>twice"), (7, "twice", "<p>twice")]


def plain_captures(rows, least_bytes=0):
    last = {}
    for key, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if key is None else key)
    out = []
    for key, _, html in rows:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((key, len(payload), digest, None if last[html or ""] < 0 else last[html or ""]))
    return out


def test_captures_against_plain_python(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "k", 1, "t") for r in rows], "page_id long, url string, html string, key string, n_bytes int, type string").repartition(7)
    out = new_path(spark, "captures")
    index = warc.capture_history(pages, out, archive_bytes=3000)
    got = index.orderBy("part", "place").collect()
    want = plain_captures(rows)
    assert Counter((r.key, r.payload_bytes, r.payload_digest) for r in got) == Counter(w[:3] for w in want)
    largest = {w[2]: w[3] for w in want}
    responses = Counter(r.payload_digest for r in got if r.record_type == "response")
    assert set(responses.values()) == {1} and responses.keys() == largest.keys()
    for r in got:
        assert r.refers_to == (None if r.record_type == "response" else largest[r.payload_digest])
        assert r.record_type == "revisit" or r.key == largest[r.payload_digest]
    assert [(r.url_key, r.at, r.record) for r in got] == sorted((r.url_key, r.at, r.record) for r in got)
    # the history of one URL, and a record fetched by its place
    hot = warc.captures_of(index, "http://hot.example.org").collect()
    assert [r.key for r in hot] == list(range(1000, 1090))
    names = {f.rsplit("/", 1)[-1]: f for f in spark.read.format("binaryFile").load(f"{out}/archives").select("path").toPandas()["path"]}
    assert len(names) > 5
    for r in [*got[:40], *hot[:3]]:
        raw = open(names[r.archive].removeprefix("file:"), "rb").read()[r.offset : r.offset + r.length]
        fields, _ = warc.parse_record(gzip.decompress(raw))
        assert fields["warc-record-id"] == f"<{r.record}>" and fields["warc-type"] == r.record_type
    whole = b"".join(gzip.decompress(open(f.removeprefix("file:"), "rb").read()) for f in names.values())
    assert whole.count(b"one text for all") == 1


def test_runs_merge_over_many_ranges(spark):
    pages = spark.createDataFrame([(i, "http://hot.example.org/" if i % 3 else f"http://h{i % 17}.org/", f"{i}") for i in range(600)], "page_id long, url string, html string").repartition(6)
    out = new_path(spark, "captures")
    warc.write_archives(pages, f"{out}/archives", archive_bytes=4000)
    runs = warc.materialize(warc.capture_runs(spark, f"{out}/archives"), "runs")
    assert runs.select("archive").distinct().count() > 6
    rows = warc.merge_runs(runs, range_entries=50).collect()
    assert max(Counter(r.part for r in rows).values()) < 200  # one URL holds two thirds of the entries
    ordered = [(r.url_key, r.at, r.record) for r in sorted(rows, key=lambda r: (r.part, r.place))]
    assert ordered == sorted(ordered) and len(ordered) == 600


def test_captures_with_text_keys_least_bytes_and_no_rows(spark):
    rows = [("a\nb%", "u", "same"), ("z", "u", "same"), ("b", "u", "longer text"), ("c", "u", "longer text")]
    pages = spark.createDataFrame(rows, "url string, page string, html string")
    index = warc.capture_history(pages, new_path(spark, "captures"), key="url", url="page", least_bytes=6)
    assert {(r.key, r.record_type, r.refers_to) for r in index.collect()} == {("a\nb%", "response", None), ("z", "response", None), ("c", "response", None), ("b", "revisit", "c")}
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.capture_history(none, new_path(spark, "captures")).collect() == []


def test_a_changed_payload_is_noticed():
    record = gzip.decompress(warc._response("urn:x", "1", "http://a/", "2024-01-01T00:00:00Z", warc.payload_digest(b"abc"), b"abd"))
    with pytest.raises(ValueError, match="not the one"):
        warc._entry(*warc.parse_record(record), "f", 0, 1)
    with pytest.raises(ValueError, match="ends within"):
        list(warc._members(gzip.compress(b"abc")[:-3]))


# ---- alignment


def plain_alignment(texts):
    """Both libraries over whole texts, every pair of tokens compared."""
    aligner = alignment.Aligner(A, B)
    found = []
    for t in texts:
        raw = (" " + (t or "")).encode()
        a = aligner.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = aligner.b.encode(t) if t else []
        if b"".join(aligner.a_bytes[i] for i in a) != raw or b"".join(aligner.b_bytes[i] for i in b) != raw:
            a, b = [], []
        spans = []
        for ids, table in ((a, aligner.a_bytes), (b, aligner.b_bytes)):
            at, places = 0, []
            for i in ids:
                places.append((i, at, at + len(table[i])))
                at += len(table[i])
            spans.append(places)
        ends = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
        groups, links, first = [], [], 0
        for end in ends:
            inside = [[x for x in s if first <= x[1] < end] for s in spans]
            groups.append("|".join(",".join(str(x[0]) for x in s) for s in inside))
            links += [(x[0], y[0]) for x in inside[0] for y in inside[1] if x[1] < y[2] and y[1] < x[2]]
            first = end
        found.append((len(a), len(b), groups, links))
    count = Counter(p for _, _, _, links in found for p in links)
    most: dict = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for n_a, n_b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), digest))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts():
    rng = random.Random(17)
    marks = [" ", "  ", "\n", "\t", " \n ", "　", " ", "▁", "\x1c", "\u0085", "​", "\r\n", "'s", "<|endoftext|>", "<s>", "<0x41>", "漢字", "🙂", "é", "é", "12345", "word", "Straße", ".", "..", "\x00", "﻿"]
    return ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 30))) for _ in range(150)]


@pytest.mark.parametrize("step", [500_000, 60])
def test_alignment_equals_whole_text_libraries(spark, monkeypatch, step):
    monkeypatch.setattr(alignment, "STEP_BYTES", step)
    texts = [r[1] for r in messy_rows() if len(r[1] or "") < 10_000] + odd_texts() + [" ".join(words(i, 40)) for i in range(20)] * 2
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pair string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokens(docs, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == plain_alignment(texts)


def test_alignment_over_chunks_and_a_small_cache(spark, monkeypatch):
    texts = [" ".join(words(i, 30, 50)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    whole = sorted(map(tuple, alignment.align_tokens(docs, A, B).collect()))
    rows = [(i, *r) for i, r in enumerate(plain_alignment(texts))]
    assert whole == rows
    aligner = alignment.Aligner(A, B)
    monkeypatch.setattr(alignment, "MOST_CACHED", 10)
    for t in texts:
        parts = aligner.parts(t)
        aligner.learn(set(parts))
        assert aligner.of(t, parts)[:3] == plain_alignment([t])[0][:3]
        aligner.forget(set(parts))


def test_general_intervals():
    import numpy as np

    a, b = np.array([[0, 2], [2, 5], [9, 10]]), np.array([[0, 1], [1, 5], [5, 7], [8, 12]])
    of_a, of_b = alignment.coalesced(a[:, 0], a[:, 1], b[:, 0], b[:, 1])
    assert of_a.tolist() == [0, 0, 2] and of_b.tolist() == [0, 0, 1, 2]
    x, y = alignment.overlaps(a[:, 0], a[:, 1], b[:, 0], b[:, 1])
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 3)]


def test_alignment_of_odd_tables(spark):
    rows = messy_rows()
    got = alignment.align_tokens(messy(spark), A, B).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {tuple(r)[1:] for r in got if r.doc_id in (2, 3)} == {(0, 0, 0, 0, 0, 0, "")}
    assert alignment.align_tokens(empty(spark), A, B).collect() == []
    clash = alignment.align_tokens(messy(spark).select(F.col("doc_id").cast("string").alias("n_links"), "text"), A, B, doc="n_links")
    assert clash.columns[0] == "key_n_links" and clash.count() == len(rows)
