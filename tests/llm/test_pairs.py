"""Jaccard join, decontamination and components against brute force."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from regionscore.llm import decontaminate, jaccard_join
from regionscore.llm.components import components
from regionscore.llm.words import WordNumbers, windows

from . import worlds


def shingle_set(text, width):
    found = (text or "").encode().lower().split()
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1)))


def brute_classes(texts: dict, width: int, num: int, den: int) -> dict:
    sets = {k: shingle_set(t, width) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and den * shared >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def copies_and_passages(seed: int) -> dict:
    """Exact copies, chains of near copies, short texts with one word changed, and a passage in many texts."""
    rng = random.Random(seed)
    texts, key = {}, 0
    passage = worlds.words(99, 60)
    for base in range(12):
        start = worlds.words(seed * 100 + base, rng.choice([3, 9, 12, 15, 18, 25, 120, 300]))
        for _ in range(rng.randrange(1, 9)):
            key += 1
            texts[key] = " ".join(start)
            if rng.random() < 0.7:
                start = list(start)
                start[rng.randrange(len(start))] = f"new{rng.randrange(50)}"
    for i in range(60):
        key += 1
        own = worlds.words(1000 + seed * 100 + i, 30 + rng.randrange(40), 5000)
        texts[key] = " ".join(own[:20] + passage + own[20:])
    base = worlds.words(5, 200)
    for i in range(80):
        key += 1
        one = list(base)
        one[(7 * i) % 200] = f"v{i}"
        texts[key] = " ".join(one)
    texts[key + 1], texts[key + 2], texts[key + 3] = None, "", "A b C"
    return texts


@pytest.mark.parametrize(("seed", "width", "num", "den"), [(1, 4, 85, 100), (2, 5, 80, 100)])
def test_classes_are_those_of_all_pairs(spark, seed, width, num, den):
    texts = copies_and_passages(seed)
    rows = jaccard_join.similarity_classes(worlds.table(spark, texts), width, num, den).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_classes(texts, width, num, den)
    assert all(r.n_shingles == len(shingle_set(texts[r.doc_id], width)) for r in rows)


def test_parities_bound_the_difference_from_below():
    """Of sets of any size, also where one has twice the parities of the other: no more than what one of them has alone."""
    rng = np.random.default_rng(3)
    for n, m, shared in [(5, 4, 4), (300, 280, 250), (500, 530, 480), (1000, 1040, 990), (2040, 2060, 0), (0, 600, 0)]:
        pool = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        one, two = pool[:n], np.concatenate([pool[:shared], pool[n : n + m - shared]])
        sizes = np.array([len(one), len(two)])
        numbers = np.concatenate([one, two])
        words = jaccard_join._parities(numbers, sizes)
        differ = sum(int(w[0] ^ w[1]).bit_count() if w[0] ^ w[1] >= 0 else (int(w[0] ^ w[1]) + 2**64).bit_count() for w in words)
        assert differ <= n + m - 2 * shared and (n + m - 2 * shared) % 2 == differ % 2
        wide = jaccard_join._wide_parities(numbers, sizes).to_pylist()
        assert [w is None for w in wide] == [k <= jaccard_join.SKETCH_BITS for k in sizes.tolist()]


@pytest.mark.parametrize("length", [100, 1100])
def test_texts_alike_but_not_enough_are_not_paired(spark, monkeypatch, length):
    """Variants of one text that share most shingles meet in long lists; their pairs were compared one by one, by the square of the group."""
    rng, base, texts = random.Random(7), worlds.words(5, length, 0), {}
    for i in range(120):
        one = list(base)
        for at in rng.sample(range(length), length // 40):
            one[at] = f"v{i}x{at}"
        texts[i] = " ".join(one)
    texts[500], texts[501] = texts[3], texts[4] + " more"
    rows, real = [], jaccard_join.materialize

    def counted(table, name):
        out = real(table, name)
        if name == "pairs":
            rows.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    found = jaccard_join.similarity_classes(worlds.table(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_classes(texts, 5, 80, 100)
    assert sum(rows) <= 5 * len(texts)


def test_classes_of_messy_and_empty_tables(spark):
    rows = jaccard_join.similarity_classes(worlds.messy(spark)).collect()
    found = {(r.doc_id, r.n_shingles > 0): r.component_id for r in rows}
    assert len(rows) == len(worlds.messy_rows())
    assert found[(7, True)] == 6 and found[(6, True)] == 6 and found[(2, False)] == 2 and found[(None, True)] is None
    kept = jaccard_join.keep_one(worlds.messy(spark))
    assert kept.columns == worlds.messy(spark).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 6, 8, 9, 10]
    assert jaccard_join.similarity_classes(worlds.empty(spark)).collect() == []


@pytest.mark.parametrize("width", [4, 5])
@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_a_slice_of_fewer_words_than_a_run(width, n):
    """One text of ``n`` words in all has one run, the same as beside other texts."""
    text = " ".join(worlds.words(n, n, 0)).encode()
    alone, owner = windows(*WordNumbers().of([text]), width)
    beside, owners = windows(*WordNumbers().of([b"", text, " ".join(worlds.words(9, 40, 0)).encode()]), width)
    assert len(alone) == 1 and owner.tolist() == [0]
    assert alone.tolist() == beside[owners == 1].tolist()


def test_classes_of_one_short_text(spark):
    rows = jaccard_join.similarity_classes(worlds.table(spark, {1: "two words"}), width=4, num=85, den=100).collect()
    assert [r.doc_id for r in rows] == [1]


def test_boundary_follows_cost():
    assert jaccard_join.subset_rows(6, 85, 100) == 1 and jaccard_join.subset_rows(7, 85, 100) == 8
    sizes = dict.fromkeys(range(1, 25), 10)
    assert jaccard_join.boundary(sizes, 0.0, 85, 100) < jaccard_join.boundary(sizes, 0.5, 85, 100)


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 160)]
    found = {r.node: r.component for r in components(spark.createDataFrame([*chain, *star, (500, 500)], "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 160)) and 500 not in found


def brute_contaminated(texts: dict, items: dict, width: int = 5, similarity: float = 0.8) -> set:
    def tokens(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def runs(ws):
        return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()

    sets = {i: runs(tokens(t)) for i, t in items.items()}
    held = {}
    for s in sets.values():
        for x in s:
            held[x] = held.get(x, 0) + 1
    weight = lambda x: math.log(1 + len(sets) / held[x]) if x in held else math.log(1 + len(sets))
    out = set()
    for k, t in texts.items():
        ws = tokens(t)
        for i, s in sets.items():
            if not s & runs(ws):
                continue
            n = len(tokens(items[i]))
            for at in range(max(1, len(ws) - n + 1)):
                w = runs(ws[at : at + n])
                either = sum(map(weight, w | s))
                if either and sum(map(weight, w & s)) / either >= similarity:
                    out.add((k, i))
                    break
    return out


def test_contaminations_are_those_of_all_windows(spark):
    rng = random.Random(3)
    items = {i: " ".join(worlds.words(300 + i, rng.randrange(8, 50), 2000)) for i in range(12)}
    items[12] = items[0]
    texts = {}
    for k in range(60):
        own = worlds.words(900 + k, rng.randrange(0, 80), 5000)
        inside = items[k % 13].split()
        if k % 4 == 1:
            inside[len(inside) // 2] = "changed"
        if k % 4 == 2:
            inside = inside[: len(inside) // 2]
        if k % 4 == 3:
            inside = [w.upper() + "," for w in inside]
        at = rng.randrange(len(own) + 1)
        texts[k] = " ".join(own[:at] + inside + own[at:]) if k % 5 else " ".join(own)
    texts[70], texts[71] = None, "!!! ..."
    benchmark = spark.createDataFrame([*items.items(), (90, None), (91, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(worlds.table(spark, texts), benchmark).collect()}
    assert found == brute_contaminated(texts, items)
    kept = decontaminate.keep_clean(worlds.table(spark, texts), benchmark)
    assert {r.doc_id for r in kept.collect()} == set(texts) - {k for k, _ in found}


def edited_items(seed: int, n_items: int, shared: int, common: int, copies: int) -> tuple[dict, dict]:
    """Template items, and texts that hold one of them with one or two words changed.

    ``common`` of ``n_items`` items begin with the same ``shared`` words; a new word weighs more than those.
    """
    rng = random.Random(seed)
    template = worlds.words(seed, shared, 0)
    items = {i: " ".join((template if i < common else []) + worlds.words(seed * 1000 + i, 3 + rng.randrange(30), 0)) for i in range(n_items)}
    texts = {}
    for k in range(copies):
        inside = items[k % common].split()
        for at in rng.sample(range(len(inside)), 1 + k % 2):
            inside[min(at, 2) if k % 3 else -1 - min(at, 3)] = f"new{k}"
        texts[k] = " ".join([*worlds.words(seed + 50 + k, 12, 0), *inside, *worlds.words(seed + 7 + k, 9, 0)])
    return items, texts


def test_edited_template_items_are_found(spark):
    items, texts = edited_items(11, 40, 30, 10, 150)
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(worlds.table(spark, texts), benchmark).collect()}
    wanted = brute_contaminated(texts, items)
    assert len(wanted) > 100 and found == wanted


def test_radius_leaves_next_to_none_out():
    radius = decontaminate.safe_radius(0.8)
    share = math.acos(0.8 * 2 / 1.8) / math.pi
    beyond = sum(math.comb(128, r) * share**r * (1 - share) ** (128 - r) for r in range(radius + 1, 129))
    assert beyond < 1e-6 and decontaminate.safe_radius(0.9) < radius < 64 and decontaminate.safe_radius(1.0) == 0


def test_contaminations_of_messy_and_empty_tables(spark):
    messy = worlds.messy(spark)
    benchmark = spark.createDataFrame([(1, "Same text here, word for word, in two rows."), (None, "a row without a key but with a text of some words")], "item_id long, text string")
    found = decontaminate.contaminations(messy, benchmark).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in found) == [(0, 0), (6, 1), (7, 1)]
    kept = decontaminate.keep_clean(messy, benchmark)
    assert kept.columns == messy.columns and kept.count() == len(worlds.messy_rows()) - 4
    assert decontaminate.contaminations(worlds.empty(spark), benchmark).collect() == []
    assert decontaminate.contaminations(messy, benchmark.limit(0)).collect() == []
