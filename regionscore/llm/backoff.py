"""Operator 3: stupid-backoff scores, computed relationally.

Documents are cut into chunks of bounded size; a chunk's table holds its words as numbers. Each
chunk lists its distinct n-grams of every order with their counts, in one block per hash partition,
so that a frequent n-gram is one entry a chunk and no partition is hot. A partition sums the counts
of its n-grams over all blocks and sends each block its totals; joined with the chunk again, they
give the score of every word, summed per document.

The score of a word after its context is ``count(context word) / count(context)`` for the longest
context with a count above 0, times ``discount`` for each word of context given up; without any
context it is the share of the word among all words. With ``leave_out`` a document's own n-grams
are taken off all counts, so a text cannot vouch for itself; a word that no other document holds
counts as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.llm.common import materialize, ship
from regionscore.llm.words import ODD_1, WordNumbers, kept, mixed, slices

#: Distinct n-grams that one hash partition holds, about.
PARTITION_GRAMS = 3_000_000
#: Text of one chunk, about; a longer text is a chunk of its own.
CHUNK_BYTES = 8_000_000


def _packed(*arrays: np.ndarray, level: int = 1) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpacked(payload: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    lengths = np.frombuffer(raw, "<i8", len(kinds), 8)
    out, at = [], 8 * (1 + len(kinds))
    for kind, n in zip(kinds, lengths.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _squeezed(rising: np.ndarray) -> np.ndarray:
    """Rising numbers as steps, byte by byte: the leading bytes of the steps are all alike and pack well."""
    steps = np.diff(rising, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view("u1").reshape(-1, 8).T).ravel()


def _restored(packed: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(packed.reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _grams(numbers: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the n-gram that ends at each place that has one, and the places."""
    at = np.arange(len(numbers)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = np.flatnonzero(at >= order - 1)
    out = np.full(len(place), order, dtype=np.uint64)
    for back in range(order - 1, -1, -1):
        out = mixed(out * ODD_1 + numbers[place - back])
    return out, place


def _listed(gram: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams by partition, then number; their counts, partitions, and the index of each given one."""
    found, inverse, times = np.unique(gram, return_inverse=True, return_counts=True)
    part = (found % np.uint64(partitions)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return found[order], times[order], part[order], rank[inverse]


def _chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: its keys, and its words as numbers with the number of words of each text."""
    key = docs.schema["key"]
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("keys", T.ArrayType(key.dataType)), T.StructField("n_words", T.LongType()), T.StructField("payload", T.BinaryType())])

    def cut(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, texts in slices(batch.column(1).to_pylist(), CHUNK_BYTES):
                numbers, counts = kept("words", WordNumbers).of(texts)
                words, index = np.unique(numbers, return_inverse=True)
                keys = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column(0).slice(first, len(texts)))
                payload = _packed(counts, words, index.astype("<u4"), level=6)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), keys, pa.array([len(numbers)], pa.int64()), pa.array([payload], pa.binary())], names=schema.names)
                number += 1

    return docs.select("key", "text").mapInArrow(cut, schema)


def _words(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts, words, index = _unpacked(payload, "<i8", "<u8", "<u4")
    return words[index], counts


def _totals(chunks: DataFrame, order: int, partitions: int) -> DataFrame:
    """For each chunk, order and partition, the corpus counts of the n-grams that the chunk lists there."""

    def listed(batches):
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                numbers, counts = _words(payload)
                for k in range(1, order + 1):
                    found, times, part, _ = _listed(_grams(numbers, counts, k)[0], partitions)
                    edges = np.searchsorted(part, np.arange(partitions + 1))
                    some = np.flatnonzero(np.diff(edges))
                    blocks = [_packed(_squeezed(found[edges[p] : edges[p + 1]]), times[edges[p] : edges[p + 1]].astype("<u4")) for p in some]
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * len(some), pa.int64()), "k": pa.array([k] * len(some), pa.int32()), "part": pa.array(some, pa.int32()), "payload": pa.array(blocks, pa.binary())})

    def summed(batches):
        chunk, k, part, grams, times = [], [], [], [], []
        for batch in batches:
            chunk += batch.column(0).to_pylist()
            k += batch.column(1).to_pylist()
            part += batch.column(2).to_pylist()
            for payload in batch.column(3).to_pylist():
                found, n = _unpacked(payload, "u1", "<u4")
                grams.append(_restored(found))
                times.append(n)
        if not grams:
            return
        _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(times)).astype("<i8")[inverse]
        ends = np.cumsum([len(g) for g in grams])
        for first in range(0, len(chunk), 64):
            some = range(first, min(first + 64, len(chunk)))
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk[i] for i in some], pa.int64()),
                "k": pa.array([k[i] for i in some], pa.int32()),
                "part": pa.array([part[i] for i in some], pa.int32()),
                "payload": pa.array([_packed(total[ends[i] - len(grams[i]) : ends[i]]) for i in some], pa.binary()),
            })

    schema = "chunk long, k int, part int, payload binary"
    return chunks.select("chunk", "payload").mapInArrow(listed, schema).repartitionById(partitions, F.col("part")).mapInArrow(summed, schema)


def _own(gram: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each n-gram is in its own document."""
    order = np.lexsort((gram, owner))
    g, o = gram[order], owner[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(g), dtype=np.int64)
    out[order] = np.bincount(group)[group] if len(g) else 0
    return out


def _scores(numbers: np.ndarray, counts: np.ndarray, totals: list[np.ndarray], order: int, partitions: int, corpus: int, discount: float, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the log scores of the words of each text, and the number of words scored with less than the full context."""
    owner = np.repeat(np.arange(len(counts)), counts)
    held = []
    for k in range(1, order + 1):
        gram, place = _grams(numbers, counts, k)
        here = totals[k - 1][_listed(gram, partitions)[3]]
        if leave_out:
            here = here - _own(gram, owner[place])
        full = np.zeros(len(numbers), dtype=np.int64)
        full[place] = here
        held.append(full)
    at = np.arange(len(numbers)) - np.repeat(np.cumsum(counts) - counts, counts)
    mine = np.repeat(counts, counts) if leave_out else 0
    longest = np.minimum(at + 1, order)
    score = np.log(np.maximum(held[0], 1)) - np.log(np.maximum(corpus - mine, 1))
    used = np.ones(len(numbers), dtype=np.int64)
    for k in range(2, order + 1):
        seen = np.flatnonzero(held[k - 1] > 0)
        score[seen] = np.log(held[k - 1][seen]) - np.log(held[k - 2][seen - 1])
        used[seen] = k
    score += (longest - used) * np.log(discount)
    return np.bincount(owner, weights=score, minlength=len(counts)), np.bincount(owner, weights=used < longest, minlength=len(counts)).astype(np.int64)


def backoff_scores(docs: DataFrame, order: int = 2, discount: float = 0.4, leave_out: bool = True, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the document, ``n_words``, ``n_backed_off``, ``log_score`` and ``mean_log_score``.

    Words are what ASCII white space separates, A-Z in lower case. No text counts as an empty one:
    no words, sum 0, no mean. Equal rows are documents of their own. Counts are over all rows.
    """
    ship(docs.sparkSession)
    plain = docs.select(F.col(doc).alias("key"), F.col(text).cast("binary").alias("text"))
    chunks = materialize(_chunks(plain), "chunks")
    corpus = chunks.agg(F.sum("n_words")).first()[0] or 0
    partitions = max(1, -(-corpus * order // PARTITION_GRAMS))
    key = plain.schema["key"].dataType
    totals = _totals(chunks, order, partitions)
    empty = F.lit(None).cast(T.ArrayType(key))
    both = chunks.select("chunk", F.lit(0).alias("k"), F.lit(0).alias("part"), "payload", "keys").unionByName(totals.withColumn("keys", empty))
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", "k", "part")
    schema = T.StructType([T.StructField(doc, key), T.StructField("n_words", T.LongType()), T.StructField("n_backed_off", T.LongType()), T.StructField("log_score", T.DoubleType())])

    def score(batches):
        held: list = []

        def finish():
            keys, numbers, counts, parts = held
            found = [np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in parts]
            total, backed = _scores(numbers, counts, found, order, partitions, corpus, discount, leave_out)
            return pa.RecordBatch.from_arrays([keys, pa.array(counts), pa.array(backed), pa.array(total)], names=schema.names)

        for batch in batches:
            for i in range(batch.num_rows):
                k, payload = batch.column(1)[i].as_py(), batch.column(3)[i].as_py()
                if k == 0:
                    if held:
                        yield finish()
                    held = [batch.column(4)[i].values, *_words(payload), [[] for _ in range(order)]]
                else:
                    held[3][k - 1].append(_unpacked(payload, "<i8")[0])
        if held:
            yield finish()

    scored = dealt.mapInArrow(score, schema)
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
