"""Operator 8: benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

A window of a document has as many words as a benchmark item. Its SimHash has 128 bits; each sums,
over its word shingles, the square root of the shingle's weight times a number that the hash of the
shingle deals evenly around 0. Fingerprints of windows and items of one size are cut into more than
``radius`` blocks; two within the radius agree on a block, so an equality join on blocks finds
all of them. Candidates are verified by the exact weighted Jaccard similarity of their shingles:
a shingle weighs ``ln(1 + items / items that hold it)``, one that no item holds ``ln(1 + items)``.

With square roots the cosine is ``shared / sqrt(window * item)`` in sums of weights, so at weighted
Jaccard ``s`` it is at least ``2s / (1 + s)`` whatever the single weights are, and the radius follows
from ``s`` alone (:func:`safe_radius`).

Windows that hold no shingle of any item have similarity 0 and are not fingerprinted: windows
start where a shared shingle puts an item's start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionscore.llm.common import materialize, once

BITS = 128
HALF = 64
#: Chance that a window just as similar as asked lies outside the radius.
MISS = 1e-6
#: Up to so many rows of a side are broadcast (under 64 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for no text."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda w: w != "")


def shingles(tokens: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words by place; fewer words are one run, none give nothing."""
    n = F.size(tokens)
    return (
        F.when(n >= width, F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(tokens, i, width))))
        .when(n > 0, F.array(F.xxhash64(tokens)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def _hashed(text: Column, width: int) -> Column:
    """Number of words ``n`` and shingle hashes ``hs`` of a text."""
    return once(words(text), lambda tokens: F.struct(F.size(tokens).alias("n"), shingles(tokens, width).alias("hs")))


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint where a count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def safe_radius(similarity: float, miss: float = MISS) -> int:
    """The least radius that a pair of this weighted Jaccard similarity exceeds with a chance of at most ``miss``.

    Bits are taken to differ as those of normal sums do, by the angle of the pair over pi, and a
    twentieth more often, since the sums are of few even numbers where a window is short.
    """
    share = min(0.5, 1.05 * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi)
    beyond = 1.0
    for radius in range(BITS):
        beyond -= math.comb(BITS, radius) * share**radius * (1 - share) ** (BITS - radius)
        if beyond <= miss:
            return radius
    return BITS


def _simhash(features: DataFrame, keys: list[str]) -> DataFrame:
    """One 128-bit fingerprint (``print0``, ``print1``) per key from rows of (key, shingle ``h``, weight ``w``)."""
    def dealt(b: int) -> Column:
        even = F.shiftright(f"g{b // 8}", 8 * (b % 8)).bitwiseAND(F.lit(255)) - F.lit(127.5)
        return F.sum(F.col("r") * even).alias(f"b{b}")

    # eight bits of hash for each bit of the fingerprint
    rows = features.select(*keys, F.sqrt("w").alias("r"), *[F.xxhash64("h", F.lit(k)).alias(f"g{k}") for k in range(BITS // 8)])
    sums = rows.groupBy(*keys).agg(*[dealt(b) for b in range(BITS)])

    def half(first: int) -> Column:
        out = F.lit(0).cast("bigint")
        for b in range(HALF):
            out = out.bitwiseOR(F.when(F.col(f"b{first + b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return out

    return sums.select(*keys, half(0).alias("print0"), half(HALF).alias("print1"))


def _blocks(prints: DataFrame, radius: int) -> DataFrame:
    """A row per block of each fingerprint; both halves are cut alike, into more than ``radius`` blocks in all."""
    per_half = min(HALF, radius // 2 + 1)
    edges = [round(i * HALF / per_half) for i in range(per_half + 1)]
    parts = [
        F.struct(F.lit(half * per_half + i).alias("block"), F.shiftrightunsigned(f"print{half}", low).bitwiseAND(F.lit((1 << (high - low)) - 1 if high - low < 64 else -1)).alias("value"))
        for half in (0, 1)
        for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    return prints.select("*", F.inline(F.array(*parts)))


def contaminations(
    docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, radius: int | None = None, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(row, document, item, ``similarity``, ``first_word``, ``n_words``) of every document that holds an item.

    ``row`` is a hash of key and text that rows are followed by, so rows without a key, or with a
    repeated one, are told apart by their texts. The best window of each pair is returned, the first
    among equals. Items and documents without words match nothing; a document with fewer words than
    an item is compared as one window. Empty tables give no rows. ``radius`` is in bits of 128, by
    default the :func:`safe_radius` of ``similarity``.
    """
    radius = safe_radius(similarity) if radius is None else radius
    # items are followed by a hash of name and text, so that one without a name is looked for as well
    named_items = benchmark.select(F.xxhash64(F.col(item), F.col(item_text)).alias("item"), F.col(item).alias("name"), F.col(item_text).alias("text"))
    items = named_items.select("item", _hashed(F.col("text"), width).alias("t")).where(F.col("t.n") > 0).dropDuplicates(["item"])
    placed = materialize(items.select("item", F.col("t.n").alias("size"), F.posexplode("t.hs").alias("place", "h")), "items")
    total = placed.select("item").distinct().count()
    known = placed.groupBy("h").agg(F.countDistinct("item").alias("df")).select("h", F.ln(1 + F.lit(float(max(total, 1))) / F.col("df")).alias("w"))
    known = materialize(known, "weights")
    unseen = F.ln(F.lit(1.0 + max(total, 1)))
    item_features = materialize(placed.select("item", "size", "h").distinct().join(_small(known), "h"), "item_features")

    rows = docs.select(F.xxhash64(F.col(doc), F.col(text)).alias("row"), F.col(doc).alias("doc"), F.col(text).alias("text"))
    hashed = rows.select("row", _hashed(F.col("text"), width).alias("t")).select("row", F.col("t.n").alias("n"), F.posexplode("t.hs").alias("at", "h"))
    met = hashed.join(_small(placed), "h")
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("place"), F.col("n") - F.col("size")))
    windows = materialize(met.select("row", "size", start.alias("start")).distinct(), "windows")

    # the words of each window, from the texts that have any
    held = rows.join(_small(windows.select("row").distinct()), "row").dropDuplicates(["row"])
    held = materialize(held.select("row", words(F.col("text")).alias("tokens")), "held_words").join(windows, "row")
    cut = once(F.slice("tokens", F.col("start") + 1, F.col("size")), lambda t: F.array_distinct(shingles(t, width)))
    features = held.select("row", "size", "start", F.explode(cut).alias("h"))
    features = features.join(_small(known), "h", "left").select("row", "size", "start", "h", F.coalesce("w", unseen).alias("w"))
    features = materialize(features, "window_features")

    window = ["row", "size", "start"]
    ours = _blocks(_simhash(features, window), radius)
    theirs = _blocks(_simhash(item_features, ["item", "size"]), radius).withColumnsRenamed({"print0": "item_print0", "print1": "item_print1"})
    near = sum((F.bit_count(F.col(f"print{half}").bitwiseXOR(F.col(f"item_print{half}"))) for half in (0, 1)), F.lit(0)) <= radius
    candidates = ours.join(_small(materialize(theirs, "item_blocks")), ["size", "block", "value"]).where(near).select(*window, "item").distinct()
    candidates = materialize(candidates, "candidates")

    totals = features.groupBy(*window).agg(F.sum("w").alias("window_w"))
    item_totals = item_features.groupBy("item").agg(F.sum("w").alias("item_w"))
    shared = (
        candidates.join(features.select(*window, "h"), window)
        .join(_small(item_features.select("item", "h", "w")), ["item", "h"])
        .groupBy(*window, "item")
        .agg(F.sum("w").alias("shared_w"))
    )
    scored = shared.join(totals, window).join(_small(item_totals), "item")
    scored = scored.withColumn("similarity", F.col("shared_w") / (F.col("window_w") + F.col("item_w") - F.col("shared_w")))
    # sums of the same weights in another order may differ in the last digits
    passed = scored.where(F.col("similarity") >= similarity - 1e-9)
    best = passed.groupBy("row", "item").agg(F.min(F.struct((-F.round("similarity", 9)).alias("less"), "start", "size")).alias("best"))
    named = rows.select("row", "doc").join(_small(best.select("row").distinct()), "row", "left_semi").distinct()
    names = named_items.select("item", "name").dropDuplicates(["item"])
    return named.join(best, "row").join(_small(names), "item").select(
        "row",
        F.col("doc").alias(doc),
        F.col("name").alias(item),
        (-F.col("best.less")).alias("similarity"),
        F.col("best.start").cast("long").alias("first_word"),
        F.col("best.size").cast("long").alias("n_words"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, radius: int | None = None, doc: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged."""
    found = contaminations(docs, benchmark, width, similarity, radius, doc, text, **names).select(F.col("row").alias("_row")).distinct()
    found = materialize(found, "contaminated")
    return docs.join(_small(found), F.xxhash64(F.col(doc), F.col(text)) == F.col("_row"), "left_anti")
