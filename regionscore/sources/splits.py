"""One large text document read by many tasks: CSV with quoted line breaks, and GeoJSON collections.

A reader that starts in the middle of a file does not know whether it is inside quotes or how deep in braces. Each
piece (a line, or the text up to a brace) says where it leads from either state; running over the pieces
of a split, and then over the few splits of a file, gives the state at every piece without reading
from the start. Pieces are written once, with what they lead to from both states of their split; whole
records are put together from there. No task holds more than a split or a record.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regionscore.storage import materialize

SPLIT = ("file", "block")
# The characters that Windows-1252 has in place of the control characters 0x80 to 0x9F.
_CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0))
_WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def decoded(raw: Column, encoding: str) -> Column:
    """Text of bytes in UTF-8 or Windows-1252."""
    if encoding.upper().replace("-", "") == "UTF8":
        return raw.cast("string")
    if encoding.lower() != "windows-1252":
        raise ValueError(f"unknown encoding {encoding}")
    return F.translate(F.decode(raw, "ISO-8859-1"), _CONTROLS, _WINDOWS)


def pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """``(file, block, at, raw)``: the bytes between occurrences of ``end``; ``at`` rises within a split."""
    text = spark.read.option("lineSep", end).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").cast("binary").alias("raw"),
    )


def states(rows: DataFrame, partition: Sequence[str], order: str) -> DataFrame:
    """The state before each row, if the first row of its partition starts outside (``s0``) or inside (``s1``).

    ``a`` and ``b`` say whether a row leads inside from outside and from inside. Rows that lead to one place from
    both forget what was before; after the last of those only the rows that swap the states count.
    """
    run = Window.partitionBy(*partition).orderBy(order)
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.col("a") & ~F.col("b")
    counted = rows.withColumn("__swaps", F.sum(swaps.cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("a") == F.col("b"), F.struct(F.col("a").alias("to"), F.col("__swaps").alias("swaps")))
    known = counted.withColumn("__fixed", F.last(fixed, ignorenulls=True).over(before))
    so_far = F.col("__swaps") - swaps.cast("int")
    since = (so_far - F.col("__fixed.swaps")) % 2 == 1
    from_fixed = F.col("__fixed.to") != since
    odd = so_far % 2 == 1
    return known.withColumns({"s0": F.coalesce(from_fixed, odd), "s1": F.coalesce(from_fixed, ~odd)}).drop("__swaps", "__fixed")


# --- CSV ---------------------------------------------------------------------------------------


def _field_patterns(sep: str) -> tuple[str, str]:
    """Patterns of a line that ends inside a quoted field: begun at a field's start, and begun inside quotes up to the next field."""
    s = re.escape(sep)
    quoted = r'"[^"]*+(?:""[^"]*+)*+'
    done = rf'(?:{quoted}"[^{s}]*+|[^"{s}][^{s}]*+|){s}'
    return rf"^(?:{done})*+{quoted}$", rf'^[^"]*+(?:""[^"]*+)*+"[^{s}]*+(?:{s}|$)'


def csv_records(spark: SparkSession, path: str, *, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """``(ordinal struct<file, block, row>, record, first)``: the records of CSV files, quoted line breaks kept.

    A field is quoted when it begins with a quote, which is doubled inside; a quote elsewhere is a character. Lines end in
    ``\\n`` or ``\\r\\n``. ``first`` marks the first record of each file. A quote that is never closed makes
    the rest of its file one record, as for any reader. Files with equal records keep them all.
    """
    opens_pattern, tail = _field_patterns(sep)
    text = decoded(F.col("raw"), encoding)
    lines = pieces(spark, path, "\n").select(*SPLIT, "at", text.alias("line"))
    bare = F.regexp_replace("line", r"\r$", "")
    opens = bare.rlike(opens_pattern)
    closes = bare.rlike(tail)
    rest = F.regexp_replace(bare, tail, "")
    goes_on = F.regexp_extract(bare, tail, 0).endswith(sep)
    quoted = F.col("line").contains('"')
    maps = {"a": quoted & opens, "b": ~quoted | ~closes | (goes_on & rest.rlike(opens_pattern))}
    run = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    known = states(lines.withColumns(maps), SPLIT, "at")
    starts = {f"l{s}": F.max(F.when(~F.col(f"s{s}"), F.col("at"))).over(run) for s in (0, 1)}
    known = materialize(known.withColumns(starts), "csv_lines")

    def end(s: int) -> Column:
        return F.max_by(F.when(F.col(f"s{s}"), F.col("b")).otherwise(F.col("a")), "at")

    splits = states(
        known.groupBy(*SPLIT).agg(end(0).alias("a"), end(1).alias("b"), F.max("l0").alias("l0"), F.max("l1").alias("l1"), F.min("at").alias("top")), ["file"], "block"
    )
    started = F.when(F.col("s0"), F.col("l1")).otherwise(F.col("l0"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    last = F.when(started.isNotNull(), F.struct(F.col("block").alias("block"), started.alias("row")))
    splits = splits.select(
        F.col("file").alias("__file"), F.col("block").alias("__block"), F.col("s0").alias("inside"), F.last(last, ignorenulls=True).over(earlier).alias("before"),
        F.min(F.struct(F.col("block").alias("block"), F.col("top").alias("row"))).over(whole).alias("top"),
    )
    placed = known.join(splits, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    inside = F.when(F.col("inside"), F.col("s1")).otherwise(F.col("s0"))
    own = F.when(F.col("inside"), F.col("l1")).otherwise(F.col("l0"))
    key = F.when(own.isNotNull(), F.struct(F.col("block").alias("block"), own.alias("row"))).otherwise(F.col("before"))
    open_after = F.when(inside, F.col("b")).otherwise(F.col("a"))
    placed = placed.select("file", key.alias("key"), "block", "at", "line", (inside | open_after).alias("part"), "top")
    alone = placed.where(~F.col("part")).select("file", "key", "line", "top")
    listed = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    several = placed.where("part").groupBy("file", "key").agg(F.array_join(F.transform(listed, lambda p: p["line"]), "\n").alias("line"), F.first("top").alias("top"))
    return alone.unionByName(several).select(
        F.struct("file", F.col("key.block").alias("block"), F.col("key.row").alias("row")).alias("ordinal"),
        F.regexp_replace("line", r"\r$", "").alias("record"),
        (F.col("key") == F.col("top")).alias("first"),
    )


def csv_fields(record: Column, sep: str) -> Column:
    """The fields of one record as an array; an empty field without quotes is NULL."""
    s = re.escape(sep)
    raw = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(rf'{s}("[^"]*+(?:""[^"]*+)*+"[^{s}]*+|[^{s}]*+)'), F.lit(1))

    def value(f: Column) -> Column:
        inner = F.regexp_extract(f, r'^"([^"]*+(?:""[^"]*+)*+)"', 1)
        return F.when(f == "", F.lit(None).cast("string")).when(f.rlike(r'^"[^"]*+(?:""[^"]*+)*+"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(f)

    return F.transform(raw, value)


def header_of(spark: SparkSession, path: str, *, sep: str = ",") -> list[str]:
    """The column names in the first line of a file, or of a folder's first file."""
    first = spark.read.option("lineSep", "\n").text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} has no header line")
    line = first[0].value.removeprefix("\ufeff").rstrip("\r")
    return [name.strip() for name in next(csv.reader([line], delimiter=sep))]


def read_csv(spark: SparkSession, path: str, names: Sequence[str], *, sep: str = ",", encoding: str = "UTF-8", skip_first: bool = True) -> DataFrame:
    """Records as string columns ``names`` and their ``ordinal``; missing fields are NULL, further ones are left out."""
    records = csv_records(spark, path, sep=sep, encoding=encoding)
    if skip_first:
        records = records.where(~F.col("first"))
    # an empty line is no record
    fields = records.where(F.col("record") != "").select("ordinal", csv_fields(F.col("record"), sep).alias("f"))
    return fields.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)], "ordinal")


# --- feature collections ------------------------------------------------------------------------

_FEATURES = r'"features"\s*:\s*\['
_COLLECTION = r'"type"\s*:\s*"FeatureCollection"'


def _outside(text: Column, inside: bool) -> Column:
    """The text without what is in strings; it begins inside one or not."""
    if inside:
        text = F.regexp_replace(text, r'^[^"]*+("|$)', "")
    return F.regexp_replace(text, r'"[^"]*+("|$)', "")


def _balance(outside: Column) -> Column:
    return F.length(F.regexp_replace(outside, r"[^{\[]", "")) - F.length(F.regexp_replace(outside, r"[^}\]]", ""))


def collection_features(spark: SparkSession, path: str) -> DataFrame:
    """``(ordinal struct<file, block, row>, feature)``: the JSON text of each feature of GeoJSON collections.

    A document is cut behind its closing braces, wherever its line breaks are. A feature ends at a brace that leads back to depth
    2 (the document and its ``features``). What is no FeatureCollection is an error.
    """
    cut = pieces(spark, path, "}").select(*SPLIT, "at", F.regexp_replace(F.col("raw").cast("string"), "^﻿", "").alias("text"))
    plain = F.regexp_replace("text", r"\\.", "")  # no escaped quotes from here on
    odd = F.length(F.regexp_replace(plain, r'[^"]', "")) % 2 == 1
    maps = {"a": odd, "b": ~odd}
    closing = {False: (~odd).cast("int"), True: odd.cast("int")}  # the brace after the piece, if no string is open there
    deltas = {f"d{s}": _balance(_outside(plain, bool(s))) - closing[bool(s)] for s in (0, 1)}

    def at_depth(pattern: str, s: int) -> Column:
        """Depth, relative to the start of the piece, at which the pattern is found; NULL if it is not."""
        head = F.regexp_extract(plain, rf"(?s)^(.*?){pattern}", 1)
        return F.when(plain.rlike(pattern), _balance(_outside(head, bool(s))))

    marks = {f"{n}{s}": at_depth(p, s) for n, p in (("f", _FEATURES), ("t", _COLLECTION)) for s in (0, 1)}
    known = states(cut.withColumns({**maps, **deltas, **marks}), SPLIT, "at")
    run = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)

    def own(name: str, s: int) -> Column:
        return F.when(F.col(f"s{s}"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    columns = {f"{n}_{s}": own(n, s) for n in ("f", "t", "d") for s in (0, 1)}
    depth = {f"depth_{s}": F.sum(f"d_{s}").over(run) for s in (0, 1)}
    known = materialize(known.withColumns(columns).withColumns(depth).drop("d0", "d1", "f0", "f1", "t0", "t1"), "json_pieces")
    splits = known.groupBy(*SPLIT).agg(
        *[F.max_by(F.when(F.col(f"s{s}"), F.col("b")).otherwise(F.col("a")), "at").alias(c) for s, c in ((0, "a"), (1, "b"))],
        *[F.max_by(f"depth_{s}", "at").alias(f"depth_{s}") for s in (0, 1)],
    )
    splits = states(splits, ["file"], "block")
    mine = F.when(F.col("s0"), F.col("depth_1")).otherwise(F.col("depth_0"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        F.col("file").alias("__file"), F.col("block").alias("__block"), F.col("s0").alias("inside"), F.coalesce(F.sum(mine).over(earlier), F.lit(0)).alias("deep")
    )

    def pick(name: str) -> Column:
        return F.when(F.col("inside"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))

    after = F.col("deep") + pick("depth")
    start = after - pick("d")
    placed = known.join(splits, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))).select(
        *SPLIT, "at", "text", after.alias("after"), (start + pick("f") == 1).alias("begins"), (start + pick("t") == 1).alias("typed"), start.alias("start")
    )
    placed = placed.withColumns({"begins": F.coalesce("begins", F.lit(False)), "typed": F.coalesce("typed", F.lit(False))})
    # in the list, at depth 2, a piece begins with a comma or with the end of the list
    closes = (F.col("start") == 2) & F.col("text").rlike(r"^\s*\]")
    opens = F.col("begins") & ~F.col("text").rlike(rf"{_FEATURES}\s*\]")
    # a brace that leads to depth 2 ends a feature (or an element of another list); the next piece begins one
    ends = (F.col("after") == 2) & ((F.col("start") >= 2) & ~closes | opens)
    count = F.sum(ends.cast("int")).over(run) - ends.cast("int")
    mark = F.when(opens, F.lit(1)).when(closes | (F.col("start") < 2) | (F.col("after") < 2), F.lit(0))
    numbered = placed.withColumns({"ends": ends, "number": count, "list": F.last(mark, ignorenulls=True).over(run)})
    numbered = materialize(numbered, "json_numbered")
    per = numbered.groupBy(*SPLIT).agg(F.sum(F.col("ends").cast("int")).alias("n"), F.max_by("list", "at").alias("list"), F.bool_or("begins").alias("begins"), F.bool_or("typed").alias("typed"))
    whole = Window.partitionBy("file")
    per = per.select(
        F.col("file").alias("__file"), F.col("block").alias("__block"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.last("list", ignorenulls=True).over(earlier).alias("open_before"),
        (F.bool_or("begins").over(whole) & F.bool_or("typed").over(whole)).alias("sound"),
    )
    if per.where(~F.col("sound")).limit(1).count():
        raise ValueError(f"{path} is not a GeoJSON FeatureCollection")
    inside = F.coalesce("list", "open_before") == 1
    joined = numbered.join(per, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))).where(inside)
    parts = joined.select("file", (F.col("before") + F.col("number")).alias("number"), "block", "at", "text", "ends", "begins")
    alone_text = F.concat("text", F.lit("}"))
    listed = F.array_sort(F.collect_list(F.struct("block", "at", alone_text.alias("text"))))
    features = parts.groupBy("file", "number").agg(
        F.min(F.struct(F.col("block").alias("block"), F.col("at").alias("row"))).alias("key"),
        F.array_join(F.transform(listed, lambda p: p["text"]), "").alias("text"),
        F.bool_or("ends").alias("ends"),
        F.bool_or("begins").alias("begins"),
    )
    body = F.when(F.col("begins"), F.regexp_replace("text", rf"(?s)^.*?{_FEATURES}", "")).otherwise(F.regexp_replace("text", r"^\s*,", ""))
    return features.where("ends").select(F.struct("file", F.col("key.block").alias("block"), F.col("key.row").alias("row")).alias("ordinal"), body.alias("feature"))
