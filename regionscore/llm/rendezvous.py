"""Operator 4: rendezvous hashing of record keys over weighted shards, in DataFrame functions only.

Every shard draws a number for a key from ``md5(key#shard)``; the score is ``weight / -ln(u)`` and
the highest score wins. A key's draws do not depend on the other shards, so another shard takes
records only into itself, and a heavier one takes its share from all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionscore.llm.common import materialize, u32

#: Cells of one shard that are numbered separately: by key hash, and by text checksum inside it.
KEY_CELLS, TEXT_CELLS = 4096, 16
UNIT = float(1 << 52)


def _draw(text: Column) -> Column:
    """A number from 0 to 2^52 - 1 from the first 13 hexadecimal digits of the MD5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _key(key: Column) -> Column:
    """Records without a key count as one key, the empty one."""
    return F.coalesce(key.cast("string"), F.lit(""))


def _scores(key: Column, weights: list[float], first: int = 0) -> Column:
    """(score, -shard) of the shards; the greatest wins, the lower shard among equals."""
    drawn = F.array(*[F.lit(float(w)) for w in weights])
    return F.transform(
        drawn,
        lambda weight, i: F.struct(
            (weight / -F.ln((_draw(F.concat(key, F.lit("#"), (i + first).cast("string"))) + 0.5) / UNIT)).alias("score"),
            (-(i + first)).alias("shard"),
        ),
    )


def shards(key: Column, weights: list[float], more: float | None = None) -> Column:
    """A struct of ``shard`` and, with the weight of one shard ``more``, of ``grown_shard``.

    Weights are positive; a weight of 0 takes nothing.
    """
    if not weights or min(weights) < 0 or max(weights) == 0:
        raise ValueError("a positive weight is needed, and none below 0")
    best = F.array_max(_scores(_key(key), weights))
    grown = best if more is None else F.greatest(best, F.array_max(_scores(_key(key), [more], len(weights))))
    return F.struct(
        (-best["shard"]).cast("int").alias("shard"),
        (F.lit(None) if more is None else -grown["shard"]).cast("int").alias("grown_shard"),
    )


def assign(docs: DataFrame, weights: list[float], more: float | None = None, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard``; columns of these names are replaced."""
    kept = docs.drop("shard", "grown_shard")
    return kept.withColumn("_shards", shards(F.col(key), weights, more)).select(*kept.columns, "_shards.*")


def slots(docs: DataFrame, weights: list[float], more: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` of every record.

    Slots are gapless from 0 in each shard, in the order of the cells, then key hash, key, size and
    checksum. Cells are cut by key hash and checksum, so one key with a third of the rows is spread
    over several; equal records are counted before they are numbered.
    """
    record = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        u32(F.col(text)).alias("text_crc32"),
    )
    placed = assign(record, weights, more, "key").withColumn("hash", _draw(_key(F.col("key"))))
    same = ["shard", "key_cell", "text_cell", "hash", "key", "size", "text_crc32", "grown_shard"]
    counted = materialize(
        placed.withColumn("key_cell", F.floor(F.col("hash") / F.lit((1 << 52) // KEY_CELLS)).cast("int"))
        .withColumn("text_cell", F.floor(F.col("text_crc32") / F.lit((1 << 32) // TEXT_CELLS)).cast("int"))
        .groupBy(*same)
        .agg(F.count("*").alias("n")),
        "rendezvous",
    )
    cell = ["shard", "key_cell", "text_cell"]
    sizes = counted.groupBy(*cell).agg(F.sum("n").alias("held"))
    by_shard = Window.partitionBy("shard").orderBy("key_cell", "text_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*cell, F.coalesce(F.sum("held").over(by_shard), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*cell).orderBy("hash", F.col("key").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("last", F.sum("n").over(inside))
    return (
        ranked.join(before, cell)
        .withColumn("slot", F.explode(F.sequence(F.col("before") + F.col("last") - F.col("n"), F.col("before") + F.col("last") - 1)))
        .select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot", "grown_shard")
    )
