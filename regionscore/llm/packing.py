"""Operator 7: harmonic packing of token sequences.

A document's ids are cut so that every piece belongs to a reciprocal class: a piece of class
``k`` is ``capacity // k`` long, and ``k`` of them fill a sequence. Cutting takes the longest
class that fits and goes on with the rest; a rest of at most ``uncut`` ids stays whole, in
the class of its own length. A bin of a class therefore always takes the same number of
pieces, bins are filled independently from numbers alone, and a full bin pads at most
``uncut`` ids. What is left over in the classes (fewer than ``k`` pieces each, so a fixed
number in all whatever the input is) is packed best-fit in one last step.
"""

from __future__ import annotations

import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.llm.common import materialize, numbered, positioned, ship
from regionscore.llm.tokenizing import WordIds
from regionscore.llm.words import kept



def cuts(n: int, capacity: int, uncut: int) -> list[tuple[int, int]]:
    """(length, pieces per bin) of the pieces of ``n`` ids, in order."""
    out = []
    while n > 0:
        if n <= uncut:
            size, per_bin = n, capacity // n
        else:
            per_bin = max(1, -(-capacity // n))
            size = capacity // per_bin
        out.append((size, per_bin))
        n -= size
    return out


def token_pieces(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", end_id: int | None = 2, capacity: int = 4096, uncut: int = 64) -> DataFrame:
    """One row per piece: the document, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``per_bin``."""
    ship(docs.sparkSession)
    key_type = docs.schema[doc].dataType
    schema = T.StructType(
        [T.StructField(doc, key_type)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
        + [T.StructField("per_bin", T.IntegerType())]
    )
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def cut(batches):
        encode = kept(("word ids", path), lambda: WordIds(path))
        for batch in batches:
            at, start, length, crc, tokens, per = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = encode(t) + end
                n, done = len(ids) // 4, 0
                for size, per_bin in cuts(n, capacity, uncut):
                    at.append(i)
                    start.append(done)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * done : 4 * (done + size)]))
                    tokens.append(n)
                    per.append(per_bin)
                    done += size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens)), pa.array(per, pa.int32())],
                names=schema.names,
            )

    return docs.select(doc, text).mapInArrow(cut, schema)


def pack(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", end_id: int | None = 2, capacity: int = 4096, uncut: int = 64) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``.

    No text is an empty one (with ``end_id`` alone as its ids). Repeated rows are packed once
    each; without any ids (an empty table, or empty texts and no ``end_id``) nothing is returned.
    """
    pieces = positioned(materialize(token_pieces(docs, path, doc, text, end_id, capacity, uncut), "pieces"))
    table = numbered(pieces.withColumn("kind", F.col("length")), "kind", "at", "of").drop("kind", "file", "row")
    full = F.floor(F.col("of") / F.col("per_bin")).cast("long")
    # classes are told apart by their length, which is at most the capacity
    kinds = pieces.groupBy("length", "per_bin").agg(F.count("*").alias("n")).withColumn("full", F.floor(F.col("n") / F.col("per_bin")).cast("long"))
    before, first = {}, 0
    for row in kinds.orderBy("length").collect():  # at most ``capacity`` classes
        before[row.length] = first
        first += row.full
    if not before:
        return pieces.select(doc, "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    starts = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    binned = F.floor(F.col("at") / F.col("per_bin")).cast("long")
    columns = [doc, "start", "length", "ids_crc32", "doc_tokens"]
    filled = table.where(binned < full).select(
        *columns,
        (starts[F.col("length")] + binned).cast("long").alias("sequence_id"),
        (F.pmod(F.col("at"), F.col("per_bin").cast("long")) * F.col("length")).cast("long").alias("offset"),
    )
    rest = table.where(binned >= full).select(*columns)
    return filled.unionByName(_best_fit(rest, capacity, first))


def _best_fit(rest: DataFrame, capacity: int, first: int) -> DataFrame:
    """The left-over pieces, longest first, each into the fullest sequence that has room.

    Fewer than ``per_bin`` pieces a class: a fixed number of rows, at most about 22,000 for 4096.
    """

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", *group.columns.difference(["length"])], ascending=False, kind="stable").reset_index(drop=True)
        by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # room -> sequences
        used: list[int] = []
        sequence, offset = [], []
        for n in group["length"].tolist():
            room = next((r for r in range(n, capacity) if by_room[r]), None)
            if room is None:
                used.append(0)
                one, room = len(used) - 1, capacity
            else:
                one = by_room[room].pop()
            sequence.append(first + one)
            offset.append(used[one])
            used[one] += n
            by_room[capacity - used[one]].append(one)
        return group.assign(sequence_id=pd.Series(sequence, dtype="int64"), offset=pd.Series(offset, dtype="int64"))

    schema = T.StructType([*rest.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rest.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(lambda group: place(group.drop(columns="_all")), schema)
