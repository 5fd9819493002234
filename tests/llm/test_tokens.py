"""Token counts, packing and training order, against the tokenizer library and exact round trips."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from regionscore.llm import packing, token_counts, training_order
from regionscore.llm.tokenizing import LETTERS, PieceLengths, WordIds

from . import worlds

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

TRICKY = [
    "a  b", "a   b", "a \n b", "\n\nx", "x\n\n", "x ", " x", "it's we'll I'M 'tis", "12 345 6a7", "a\tb", "é é", "<|endoftext|>", "a<|b", "ÀÖØöøÿĲž", "x–y — “z” ‘q’ … €5",
    "İstanbul ŉ ſ ª º µ ² ½", "漢字", "🙂🙂", "a b", " ", "don't\nstop", "Wort.\nZeile", "-- ** %%%", "_a_b_", "x" * 500,
]


@pytest.mark.parametrize("text", TRICKY)
def test_cached_encoding_is_the_librarys(text):
    by_word, by_piece = WordIds(WORDS), PieceLengths(BYTES, {})
    assert np.frombuffer(by_word(text), "<u4").tolist() == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    assert by_piece(text) == len(Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids)


def test_every_plain_letter_is_split_as_the_library_splits():
    by_word, by_piece, whole, pieces = WordIds(WORDS), PieceLengths(BYTES, {}), Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    import re

    for code in range(32, 0x180):
        c = chr(code)
        if c == "|" or not (code < 127 or re.match(f"[{LETTERS}¡¿«»]", c)):
            continue
        text = f"ab{c}cd 1{c}2 {c} {c}{c}.{c}"
        assert np.frombuffer(by_word(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, hex(code)
        assert by_piece(text) == len(pieces.encode(text, add_special_tokens=False).ids), hex(code)


def test_counts_of_messy_rows(spark):
    library = Tokenizer.from_file(BYTES)
    for table_size in (4, 65_536):
        rows = token_counts.token_counts(worlds.messy(spark), BYTES, table_size=table_size).collect()
        assert len(rows) == len(worlds.messy_rows())
        assert all(r.n_tokens == (len(library.encode(r.text, add_special_tokens=False).ids) if r.text else 0) for r in rows)
    assert token_counts.token_counts(worlds.empty(spark), BYTES).collect() == []


def test_packing_holds_every_id_once(spark):
    library = Tokenizer.from_file(WORDS)
    rows = packing.pack(worlds.messy(spark), WORDS, capacity=256, uncut=8).collect()
    wanted = [np.array((library.encode(t, add_special_tokens=False).ids if t else []) + [2], "<u4") for _, t, *_ in worlds.messy_rows()]
    keys = [k for k, *_ in worlds.messy_rows()]
    expected = sum(len(w) for w in wanted)
    assert sum(r.length for r in rows) == expected
    for r in rows:
        assert any(k == r.doc_id and len(w) == r.doc_tokens and zlib.crc32(w[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for k, w in zip(keys, wanted, strict=True))
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_sequence) * 256 - expected < 256 * 2 + 8 * len(by_sequence)
    assert packing.pack(worlds.empty(spark), WORDS).collect() == []


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 100, 2047, 2048, 4000, 4096, 4097, 123_456])
def test_cuts_are_reciprocal_classes(n):
    found = packing.cuts(n, 4096, 64)
    assert sum(size for size, _ in found) == n
    assert all(size * per <= 4096 and 4096 - size * per < 64 for size, per in found)
    assert len(found) <= n // 4096 + 6


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100, 4097, 65_537])
def test_permutation_is_one_to_one_and_keyed(size):
    first, second = (training_order.permute(np.arange(size), size, key) for key in (1, 2))
    assert sorted(first.tolist()) == list(range(size))
    assert size < 100 or (first != second).any()


def test_shards_round_trip(spark, tmp_path):
    library = Tokenizer.from_file(WORDS)
    out = str(tmp_path / "shards")
    length, per_shard = 32, 64
    rows = training_order.materialise(worlds.messy(spark), WORDS, out, length=length, per_shard=per_shard).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    files = {int(p.parent.name.split("=")[1]): p.read_bytes() for p in (tmp_path / "shards" / "shards").glob("shard=*/part-*")}
    assert sum(map(len, files.values())) == len(rows) * (2 * length + 2)
    texts = {}
    for r in rows:
        ids = files[r.shard][r.byte_offset : r.byte_offset + 2 * length]
        assert zlib.crc32(ids) == r.ids_crc32 and files[r.shard][r.byte_offset + 2 * length :][:2] == b"\n\n"
        ids, at = np.frombuffer(ids, "<u2"), 0
        for doc, start, n in r.pieces:
            texts.setdefault(doc, []).append((start, ids[at : at + n].tolist()))
            at += n
        assert at == r.n_tokens
    for key, text in ((1, worlds.messy_rows()[0][1]), (5, worlds.messy_rows()[4][1]), (2, "")):
        whole = [i for _, part in sorted(texts[key]) for i in part]
        assert whole == library.encode(text, add_special_tokens=False).ids + [2]
    later = training_order.read_from(spark, out, 70).collect()
    assert sorted(r.slot for r in later) == list(range(70, len(rows)))
    assert {r.slot: zlib.crc32(bytes(r.ids)) for r in later} == {r.slot: r.ids_crc32 for r in rows if r.slot >= 70}
    assert training_order.materialise(worlds.empty(spark), WORDS, str(tmp_path / "none"), length=length).collect() == []


def test_reading_on_opens_later_shards_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(worlds.words(i, 60))) for i in range(40)], "doc_id long, text string").repartition(3)
    out = str(tmp_path / "order")
    rows = training_order.materialise(docs, WORDS, out, length=16, per_shard=20).count()
    later = training_order.read_from(spark, out, 50)
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert "shard" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert [r.slot for r in later.orderBy("slot").collect()] == list(range(50, rows))
    assert training_order.read_from(spark, out, rows + 5).collect() == []


def test_wide_ids_and_key_names(spark, monkeypatch):
    monkeypatch.setattr(training_order, "id_width", lambda path: 4)
    docs = spark.createDataFrame([("a", "one two three four five"), ("b", None), (None, "six")], "length string, text string").coalesce(1)
    got = training_order.sequences(docs, WORDS, 4, doc="length").collect()
    ids = b"".join(r.ids[: 4 * r.n_tokens] for r in got)
    plain = [i for t in ("one two three four five", "", "six") for i in [*Tokenizer.from_file(WORDS).encode(t, add_special_tokens=False).ids, 2]]
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == plain
    pieces = [p for r in got for p in r.pieces]
    assert {p.key_length for p in pieces} == {"a", "b", None} and sum(p.length for p in pieces) == len(plain)


def test_the_first_tier_outlives_an_overflow_of_the_second():
    counter = PieceLengths(BYTES, {" the": 1, " of": 1})
    counter.lengths.rest.half = 50
    library = Tokenizer.from_file(BYTES)
    for i in range(40):
        text = " the of " + " ".join(worlds.words(i, 40, 0))
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert counter.lengths[" the"] == 1 and dict.__contains__(counter.lengths, " of") and len(counter.lengths) == 2
    assert len(counter.lengths.rest) <= 50 and len(counter.lengths.rest.before) <= 50


def test_word_ids_with_a_small_table():
    by_word = WordIds(WORDS)
    by_word.words.half = by_word.pieces.half = 20
    library = Tokenizer.from_file(WORDS)
    for i in range(40):
        text = ", ".join(worlds.words(i % 7, 50, 0)) + "! 12 it's."
        assert np.frombuffer(by_word(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
