"""Keyed table operators: first/last wins, disjunctive joins, snapshot sync, set differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flag_first(df: DataFrame, key: str, order: str, flag: str = "is_first") -> DataFrame:
    """Mark the first row of each key in ``order`` (which must be unique per key).

    Only the smallest order per key is computed, then matched back on key *and* order: both
    steps spread a key that fills a third of the table, unlike numbering its rows in one window.
    """
    firsts = df.groupBy(key).agg(F.min(order).alias(order)).withColumn(flag, F.lit(True))
    return df.join(firsts, [key, order], "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def first_by_order(df: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """``(first rows, later duplicates)`` per key."""
    flagged = flag_first(df, key, order)
    return flagged.where("is_first").drop("is_first"), flagged.where(~F.col("is_first")).drop("is_first")


def last_by_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest order per key."""
    lasts = df.groupBy(key).agg(F.max(order).alias(order))
    return df.join(lasts, [key, order], "left_semi")


def lowest_owner(pairs: DataFrame, item: str, owner: str) -> DataFrame:
    """One owner per item: the lowest (partial minimum on the map side)."""
    return pairs.groupBy(item).agg(F.min(owner).alias(owner))


def left_join_any(
    left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], *, left_id: str, right_id: str
) -> DataFrame:
    """Left join on ``a = x OR b = y`` without a nested loop.

    Each side is listed once per alternative key; a pair that meets through several keys appears
    once, and a left row meeting several right rows appears once for each of them.
    """
    def keys(df: DataFrame, ident: str, names: list[str], alias: str) -> DataFrame:
        listed = F.array(*[F.struct(F.lit(i).alias("k"), F.col(n).cast("string").alias("v")) for i, n in enumerate(names)])
        return (
            df.select(F.col(ident).alias(alias), F.explode(listed).alias("key"))
            .select(alias, "key.k", "key.v")
            .where(F.col("v").isNotNull())
        )

    met = (
        keys(left, left_id, [p[0] for p in pairs], "__l")
        .join(keys(right, right_id, [p[1] for p in pairs], "__r"), ["k", "v"])
        .select("__l", "__r")
        .distinct()
    )
    clash = set(left.columns) & set(right.columns)
    renamed = right.select(*[F.col(c).alias(f"right_{c}" if c in clash else c) for c in right.columns])
    rid = f"right_{right_id}" if right_id in clash else right_id
    return (
        left.join(met, F.col(left_id) == F.col("__l"), "left")
        .join(renamed, F.col("__r") == F.col(rid), "left")
        .drop("__l", "__r")
    )


def blank_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns})


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed staging: the declared columns in the declared order, cast; an unreadable value fails."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def try_cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def sync_snapshot(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(next, diff)`` of replacing ``current`` by ``incoming`` for a key.

    The next state equals the incoming snapshot. The diff lists every key with its action:
    inserted, updated (some column differs), unchanged or deleted.
    """
    keys = list(keys)
    values = [c for c in incoming.columns if c not in keys]
    digest = F.xxhash64(*[F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"}) for c in values])
    before = current.select(*keys, digest.alias("__old"), F.lit(True).alias("__in_old"))
    after = incoming.select(*keys, digest.alias("__new"), F.lit(True).alias("__in_new"))
    action = (
        F.when(F.col("__in_old").isNull(), "inserted")
        .when(F.col("__in_new").isNull(), "deleted")
        .when(F.col("__old") != F.col("__new"), "updated")
        .otherwise("unchanged")
    )
    diff = before.join(after, keys, "full_outer").select(*keys, action.alias("action"))
    return incoming, diff


def rows_absent_from(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    return current.join(incoming.select(*keys).distinct(), list(keys), "left_anti")


def key_differences(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """``(key, problem)``: expected keys not seen and seen keys not expected."""
    missing = expected.join(seen, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    unexpected = seen.join(expected, key, "left_anti").select(key, F.lit("unexpected").alias("problem"))
    return missing.unionByName(unexpected).distinct()


def schema_differences(df: DataFrame, reference: DataFrame) -> list[tuple[str, str]]:
    """Columns (with their type) that ``df`` has and ``reference`` does not."""
    known = {(f.name, f.dataType.simpleString()) for f in reference.schema.fields}
    return [
        (f.name, f.dataType.simpleString())
        for f in df.schema.fields
        if (f.name, f.dataType.simpleString()) not in known
    ]


def columns_in_order(df: DataFrame, expected: Sequence[str]) -> bool:
    """Whether the existing columns are a prefix of the published layout."""
    return list(expected[: len(df.columns)]) == df.columns


def prune_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns a flat sink cannot take: non-scalar ones and those without any value."""
    scalar = [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) and f.name not in keep
    ]
    filled = df.agg(*[F.count(F.col(c)).alias(c) for c in scalar]).first()
    return df.select(*[c for c in df.columns if c in keep or (c in scalar and filled[c] > 0)])


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; a rejected row names the first rule it breaks. NULL breaks a rule."""
    reason = F.coalesce(
        *[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()],
        F.lit(None).cast("string"),
    )
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())
