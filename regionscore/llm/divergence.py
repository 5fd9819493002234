"""Operator 11: how far the sources of a language differ in their words, from count-level bitmaps.

Terms are runs of letters and of characters beyond ASCII, A-Z in lower case. A language keeps the
terms that at least ``least_docs`` of its documents hold. Every (language, source) group and every
language gives a kept term the share ``p = 1 + floor(SCALE * (count + 2) / (N + 2 * V))``; two shares
differ by ``f(p, q) = floor((p - q)^2 / (p + q))``. All of it is whole-number arithmetic.

The distance of two groups is the sum of f over all kept terms. f depends on the two counts alone, so
the terms are not walked: the kept terms of a language lie in blocks of like frequency, each group
stores one bitset of the block's terms for every count it has there, and the AND of two bitsets,
its bits counted, says how many terms have that pair of counts. That number is multiplied by f; the terms
with count 0 on one side or both are what the AND leaves over. Frequent terms have counts of
their own, so their blocks are small; a block of rare terms has few counts and long bitsets.

Every pair of sources of a language is a row of the result, so a language with S sources has about
S * S of them; pairs are made block by block in tiles of sources, never in one task for a language.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionscore.llm.common import materialize, ship

SCALE = 1_000_000_000
#: A-Z to lower case, letters and bytes beyond ASCII as they are, all else to a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms of a block, about, by the least number of occurrences its terms have.
BLOCK_TERMS = ((4096, 64), (64, 512), (0, 4096))
#: Sources of a tile, about.
TILE_SOURCES = 32
#: Entries a task holds before it hands its counts on.
MOST_HELD = 200_000


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of each term in each group of ``lang``, ``source``, ``text``.

    Counts are summed in the task first, so a frequent term or a large group is one row a task. A
    group has a row without a term too, so that groups of empty texts are known.
    """

    def count(batches):
        held: dict = defaultdict(Counter)
        seen: dict = defaultdict(Counter)
        groups: set = set()

        def handed_on():
            rows = [(g, t, n, seen[g][t]) for g, terms in held.items() for t, n in terms.items()]
            rows += [(g, None, 0, 0) for g in groups]
            for first in range(0, len(rows), 50_000):
                part = rows[first : first + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0][0] for r in part], pa.string()),
                        pa.array([r[0][1] for r in part], pa.string()),
                        pa.array([r[1] for r in part], pa.binary()),
                        pa.array([r[2] for r in part], pa.int64()),
                        pa.array([r[3] for r in part], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "df"],
                )
            for table in (held, seen, groups):
                table.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                group = (lang, source)
                groups.add(group)
                if text:
                    terms = text.translate(LETTERS).split()
                    held[group].update(terms)
                    seen[group].update(set(terms))
            if sum(map(len, held.values())) >= MOST_HELD:
                yield from handed_on()
        if groups:
            yield from handed_on()

    counted = docs.mapInArrow(count, "lang string, source string, term binary, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(count: Column | str, total: str, kept: str) -> Column:
    """The share of a count; the product is a decimal, so no count is too large."""
    counted = (F.col(count) if isinstance(count, str) else count) + 2
    whole = counted.cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    size = (F.col(total) + 2 * F.col(kept)).cast("decimal(19,0)")
    return 1 + F.call_function("div", whole, size)


def _vocabulary(counted: DataFrame, least_docs: int) -> DataFrame:
    """The kept terms of each language with their block (``level``, ``bucket``) and place in it.

    A block holds terms with like numbers of occurrences, dealt to it by hash.
    """
    terms = counted.where(F.col("term").isNotNull())
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= least_docs)
    kept = materialize(kept.select("lang", "term", "total", F.floor(F.log2("total")).cast("int").alias("level")), "kept_terms")
    size = F.lit(BLOCK_TERMS[-1][1])
    for least, block in reversed(BLOCK_TERMS[:-1]):
        size = F.when(F.pow(F.lit(2.0), F.col("level")) >= least, F.lit(block)).otherwise(size)
    buckets = kept.groupBy("lang", "level").agg(F.count("*").alias("n")).select("lang", "level", F.ceil(F.col("n") / size).alias("buckets"))
    placed = kept.join(buckets, ["lang", "level"]).withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets"))).drop("buckets")
    inside = Window.partitionBy("lang", "level", "bucket").orderBy("term")
    return placed.withColumn("place", F.row_number().over(inside) - 1)


def _groups(counted: DataFrame, counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Every group with its occurrences of kept terms, and those and the kept terms of its language."""
    all_groups = counted.groupBy("lang", "source").agg(F.lit(1).alias("_one")).drop("_one")
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    languages = vocabulary.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("kept"))
    known = all_groups.join(sizes, ["lang", "source"], "left").join(languages, "lang", "left")
    return known.na.fill(0, ["group_n", "lang_n", "kept"])


def bitsets(counts: DataFrame) -> DataFrame:
    """For each group and block: the counts that occur, and the terms of each count as 64-bit words.

    Only words with a bit in them are held: ``counts``, ``words`` and ``bits`` are parallel arrays.
    """
    word, bit = F.floor(F.col("place") / 64).cast("int"), F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    sets = counts.groupBy("lang", "level", "bucket", "source", "n", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    packed = sets.groupBy("lang", "level", "bucket", "source").agg(F.collect_list(F.struct("n", "word", "bits")).alias("s"))
    return packed.select("lang", "level", "bucket", "source", F.col("s.n").alias("counts"), F.col("s.word").alias("words"), F.col("s.bits").alias("bits"))


class _Levels:
    """The bitsets of one group in one block, and the shares of their counts."""

    def __init__(self, counts, words, bits, total: int, kept: int, block: int):
        counts = np.asarray(counts, dtype=np.int64)
        levels, which = np.unique(counts, return_inverse=True)
        self.sets = np.zeros((len(levels), -(-block // 64)), dtype=np.uint64)
        self.sets[which, np.asarray(words, dtype=np.int64)] = np.asarray(bits, dtype=np.int64).view(np.uint64)
        self.held = np.bitwise_count(self.sets).sum(axis=1, dtype=np.int64)
        size = total + 2 * kept
        self.zero = 1 + SCALE * 2 // size
        self.share = np.array([1 + SCALE * (c + 2) // size for c in levels.tolist()], dtype=np.int64)


def _f(p, q):
    return (p - q) * (p - q) // (p + q)


def _distance(a: _Levels, b: _Levels, block: int) -> int:
    """The sum of f over the terms of a block."""
    joint = np.zeros((len(a.sets), len(b.sets)), dtype=np.int64)
    for i, row in enumerate(a.sets):
        joint[i] = np.bitwise_count(row & b.sets).sum(axis=1, dtype=np.int64)
    both = int((joint * _f(a.share[:, None], b.share[None, :])).sum())
    only_a = int(((a.held - joint.sum(axis=1)) * _f(a.share, b.zero)).sum())
    only_b = int(((b.held - joint.sum(axis=0)) * _f(a.zero, b.share)).sum())
    neither = block - int(a.held.sum()) - int(b.held.sum()) + int(joint.sum())
    return both + only_a + only_b + neither * _f(a.zero, b.zero)


def _pairs(groups: DataFrame, vocabulary: DataFrame, sets: DataFrame) -> DataFrame:
    """The distance of every two sources of a language: ``lang``, ``a``, ``b``, ``value``, ``a`` before ``b``."""
    blocks = vocabulary.groupBy("lang", "level", "bucket").agg(F.count("*").alias("block"))
    # a language without kept terms has one block without terms, so that its pairs are there
    bare = groups.where(F.col("kept") == 0).select("lang", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("block")).distinct()
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE_SOURCES).alias("tiles"))
    tiled = groups.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
    cells = blocks.unionByName(bare).join(tiled, "lang").join(sets, ["lang", "level", "bucket", "source"], "left")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    dealt = cells.withColumn("other", other).select(
        "lang", "level", "bucket", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"), "tile", "source", "group_n", "kept", "block", "counts", "words", "bits"
    )

    def compare(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["source"].encode())
        lang, same = rows[0]["lang"], rows[0]["tile_a"] == rows[0]["tile_b"]
        levels = [_Levels(r["counts"] or [], r["words"] or [], r["bits"] or [], r["group_n"], r["kept"], r["block"]) if r["block"] else None for r in rows]
        out = [
            (rows[i]["source"], rows[j]["source"], _distance(levels[i], levels[j], rows[i]["block"]) if levels[i] else 0)
            for i in range(len(rows))
            for j in range(i + 1, len(rows))
            if same or rows[i]["tile"] != rows[j]["tile"]
        ]
        return pa.table({
            "lang": pa.array([lang] * len(out), pa.string()),
            "a": pa.array([r[0] for r in out], pa.string()),
            "b": pa.array([r[1] for r in out], pa.string()),
            "value": pa.array([r[2] for r in out], pa.int64()),
        })

    compared = dealt.groupBy("lang", "level", "bucket", "tile_a", "tile_b").applyInArrow(compare, "lang string, a string, b string, value long")
    return compared.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergence_audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """Distances between the sources of each language, and the terms that mark each source.

    Columns ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``. Part ``pair``: every other source of
    the language and the distance to it; part ``term``: the ``top`` kept terms that the source holds more often
    than its language, by their share of the distance. Ranks follow the value, then the item's bytes.

    No text, language or source counts as an empty one. Repeated rows are documents of their own. A
    group without terms has count 0 everywhere; a language that keeps no term gives distance 0. Other
    columns are not read. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))), F.col(text).cast("binary").alias("text"))
    counted = materialize(term_counts(plain), "term_counts")
    vocabulary = materialize(_vocabulary(counted, least_docs), "vocabulary")
    counts = materialize(counted.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]), "kept_counts")
    groups = materialize(_groups(counted, counts, vocabulary), "groups")
    pairs = materialize(_pairs(groups, vocabulary, materialize(bitsets(counts), "bitsets")), "source_pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    shares = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").cast("string").alias("item"), _share("n", "group_n", "kept").alias("p"), _share("total", "lang_n", "kept").alias("q")
    )
    value = F.expr("(p - q) * (p - q) div (p + q)")
    marking = shares.where(F.col("p") > F.col("q")).select("lang", "source", "item", value.alias("value"))
    return _ranked(both, "pair").unionByName(_ranked(marking, "term").where(F.col("rank") <= top))
