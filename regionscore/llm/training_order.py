"""Operator 2: training-order materialisation.

Texts become ids, ids become sequences of ``length`` in the order of the input, and a keyed
Feistel network over the sequence numbers gives every sequence its place (``slot``) in the
training order: a permutation computed from the number alone. Slots are cut into shards of
``per_shard`` sequences, one task and one file each, in which every record has the same
number of bytes; a reader seeks to any slot and goes on from there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.llm.common import key_name, new_path, positioned, ship
from regionscore.llm.tokenizing import WordIds, tokenizer
from regionscore.llm.words import kept

#: Ids of a step, in bytes, about.
STEP_BYTES = 4_000_000
#: Ends every record, as the text writer puts a line end; two bytes keep 16-bit ids aligned.
RECORD_END = "\n\n"
#: Up to so many rows of about 100 bytes, one for each file of the working table, are broadcast.
MOST_FILES = 500_000


def _mix(x: np.ndarray, key: int, turn: int) -> np.ndarray:
    """A keyed 64-bit mixing function (shifts and odd multipliers)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, size: int, key: int, turns: int = 6) -> np.ndarray:
    """The keyed permutation of 0..size-1 at ``numbers``.

    The network permutes the next even power of two; a value outside the range walks along its
    cycle until it is inside, which keeps the map one-to-one. The power is below 4 * size, so
    a walk takes fewer than four steps on average.
    """
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & low
        for turn in range(turns):
            left, right = right, left ^ (_mix(right, key, turn) & low)
        x = (left << shift) | right
        out[todo] = x
        todo = todo[x >= np.uint64(size)]
    return out.astype(np.int64)


def id_width(path: str) -> int:
    """Bytes of an id: two where the vocabulary allows it, else four."""
    return 2 if tokenizer(path).get_vocab_size() <= 1 << 16 else 4


def sequences(docs: DataFrame, path: str, length: int, doc: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Fixed-length sequences of ids (:func:`id_width` bytes each), in input order: ``ids``, ``n_tokens`` and the ``pieces`` of documents.

    Ids of consecutive documents follow one another, ``end_id`` after each; the last sequence of
    a task is filled up with ``end_id``. Documents and sequences are cut against each other as arrays.
    """
    ship(docs.sparkSession)
    kind = f"<u{id_width(path)}"
    name = key_name(doc, ("start", "length"))
    piece = T.StructType([T.StructField(name, docs.schema[doc].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    schema = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("pieces", T.ArrayType(piece))])

    def rows(ids: np.ndarray, begins: np.ndarray, keys: pa.Array, n_tokens: np.ndarray) -> pa.RecordBatch:
        """Whole sequences of ``ids``; document i begins at ``begins[i]``, below 0 if in an earlier batch."""
        firsts = np.arange(0, len(ids), length)
        end = int(n_tokens.sum())  # of the documents; what follows is filled up
        cuts = np.union1d(np.maximum(begins, 0), firsts)
        cuts = cuts[cuts < end]
        owner = np.searchsorted(begins, cuts, side="right") - 1
        struct = pa.StructArray.from_arrays(
            [keys.take(pa.array(owner)), pa.array(cuts - begins[owner]), pa.array(np.diff(np.append(cuts, end)))], names=[name, "start", "length"]
        )
        offsets = np.append(np.searchsorted(cuts, firsts), len(cuts)).astype(np.int32)
        size = length * ids.dtype.itemsize
        edges = pa.py_buffer((np.arange(len(firsts) + 1) * size).astype(np.int32).tobytes())
        whole = pa.Array.from_buffers(pa.binary(), len(firsts), [None, edges, pa.py_buffer(ids.tobytes())])
        return pa.RecordBatch.from_arrays([whole, pa.array(n_tokens.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), struct)], names=schema.names)

    def cut(batches):
        encode = kept(("word ids", path), lambda: WordIds(path))
        end = np.array([end_id], dtype="<u4").tobytes()
        tail, begins, keys = np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64), None
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, held = [], 0  # a step of bounded size
                while at + len(texts) < batch.num_rows and held < STEP_BYTES:
                    texts.append(encode(batch.column(1)[at + len(texts)].as_py()) + end)
                    held += len(texts[-1])
                new = np.frombuffer(b"".join(texts), dtype="<u4").astype(kind)
                sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) // 4
                mine = batch.column(0).slice(at, len(texts))
                at += len(texts)
                begins = np.concatenate([begins, len(tail) + np.cumsum(sizes) - sizes])
                keys = mine if keys is None else pa.concat_arrays([keys, mine])
                tail = np.concatenate([tail, new])
                full = len(tail) // length * length
                if full:
                    yield rows(tail[:full], begins, keys, np.full(full // length, length))
                    first = np.searchsorted(begins, full, side="right") - 1
                    open_ = full < len(tail)
                    begins, keys, tail = (begins[first:] - full, keys.slice(first), tail[full:]) if open_ else (begins[:0], None, tail[:0])
        if len(tail):
            yield rows(np.concatenate([tail, np.full(length - len(tail), end_id, dtype=kind)]), begins, keys, np.array([len(tail)]))

    return docs.select(doc, text).mapInArrow(cut, schema)


def materialise(docs: DataFrame, path: str, out: str, key: int = 20_240_229, length: int = 2048, per_shard: int = 8192, doc: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Write the shards under ``out`` and return one row per sequence, without its ids.

    Columns: ``slot``, ``shard``, ``byte_offset`` in the shard's file, ``n_tokens``, ``ids_crc32``,
    ``pieces``. Files are ``out/shards/shard=N/part-*``: ``length`` little-endian ids of :func:`id_width` bytes and
    ``RECORD_END`` per record. ``out/manifest`` has a row per shard. A key column named ``start`` or ``length``
    has ``key_`` before its name in the pieces. The ids are in a working table
    while the shards are written, so a lost task is repeated from the same rows. No text gives
    ``end_id`` alone; an empty table gives no shard; equal rows give a sequence each.
    """
    spark = docs.sparkSession
    working = new_path(spark, "sequences")
    sequences(docs, path, length, doc, text, end_id).write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}).parquet(working)
    table = positioned(spark.read.parquet(working)).withColumn("all", F.lit(0))
    size = table.count()
    width = id_width(path)
    stride = width * length + len(RECORD_END)

    @F.pandas_udf("long")
    def slot_of(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), size, key))

    files = table.groupBy("file").agg(F.count("*").alias("n"))
    placed = _placed(table, files).withColumn("slot", slot_of("number")).withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    shards = max(1, -(-size // per_shard))
    (
        placed.select("shard", "slot", F.col("ids").cast("string").alias("value"))
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", "slot")
        .select("shard", "value")
        .write.partitionBy("shard")
        .option("lineSep", RECORD_END)
        .text(f"{out}/shards")
    )
    rows = placed.select(
        "slot",
        "shard",
        (F.pmod(F.col("slot"), F.lit(per_shard)) * stride).cast("long").alias("byte_offset"),
        "n_tokens",
        F.crc32("ids").alias("ids_crc32"),
        "pieces",
    )
    rows.groupBy("shard").agg(F.min("slot").alias("first_slot"), F.count("*").alias("n_sequences"), (F.count("*") * stride).alias("n_bytes"), F.sum("ids_crc32").alias("crc_sum"), F.lit(width).alias("id_width"), F.lit(length).alias("length"), F.lit(per_shard).alias("per_shard")).write.parquet(f"{out}/manifest")
    return rows


def _placed(table: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with their number in the whole table: rows before the file, plus the place in the file."""
    from pyspark.sql import Window

    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)
    # one small row per file: broadcast unless there are very many files
    few = files.count() <= MOST_FILES
    before = files.select(F.col("file").alias("_file"), (F.sum("n").over(order) - F.col("n")).alias("_before"))
    return table.join(F.broadcast(before) if few else before, F.col("file") == F.col("_file")).withColumn("number", F.col("_before") + F.col("row")).drop("_file", "_before", "all")


def read_from(spark: SparkSession, out: str, slot: int) -> DataFrame:
    """The sequences from ``slot`` on: ``slot`` and ``ids``; earlier shards are not opened, nor are records before it unpacked.

    Sizes come from the manifest. A slot beyond the last gives no rows.
    """
    layout = spark.read.parquet(f"{out}/manifest").select("id_width", "length", "per_shard").first()
    if layout is None:
        return spark.createDataFrame([], "slot long, ids binary")
    size, per_shard = layout.id_width * layout.length, layout.per_shard
    stride = size + len(RECORD_END)
    files = spark.read.format("binaryFile").load(f"{out}/shards").where(F.col("shard") >= slot // per_shard)

    def records(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                first = batch.column(0)[i].as_py() * per_shard
                content = memoryview(batch.column(1)[i].as_buffer())
                for start in range(max(0, slot - first), len(content) // stride, 1024):
                    some = range(start, min(start + 1024, len(content) // stride))
                    ids = [bytes(content[k * stride : k * stride + size]) for k in some]
                    yield pa.RecordBatch.from_arrays([pa.array([first + k for k in some], pa.int64()), pa.array(ids, pa.binary())], names=["slot", "ids"])

    return files.select(F.col("shard").cast("long").alias("shard"), "content").mapInArrow(records, "slot long, ids binary")
