"""Operator 9: document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into short paragraphs: at line ends, and inside a line where the hash of a word says
so, hence at the same places in two versions. A paragraph's digest covers its words and how often
it came before in the text. Each digest goes into three cells of a sketch (count, digest sum,
check sum). The difference of two sketches holds only what the versions do not share; cells with a
single digest are peeled until nothing is left, which recovers the differing digests. When peeling
gets stuck, both sketches are made again with twice the cells.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.llm.common import ship
from regionscore.llm.words import ODD_1, ODD_2, WordNumbers, kept, mixed

#: One word in so many ends a paragraph, besides line ends.
WORDS_PER_PARAGRAPH = 4
#: Cells of each of the three parts of the published sketch, and of the first sketch that is peeled.
PUBLISHED_CELLS, FIRST_CELLS = 8, 16
#: What tells the three cells of a digest apart.
STEPS = np.arange(1, 4, dtype=np.uint64) * ODD_1


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests of all texts one after another, and the number for each text; distinct within a text."""
    known = kept("words", WordNumbers)
    # a line end becomes a word of its own, so that it ends a paragraph and is part of it
    numbers, counts = known.of([t.replace(b"\n", b" \x01 ") for t in texts], lower=False)
    if not len(numbers):
        return np.zeros(0, dtype=np.uint64), counts
    line = np.uint64(known[b"\x01"])
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = (numbers == line) | (mixed(numbers) % np.uint64(WORDS_PER_PARAGRAPH) == 0)
    last = np.ones(len(numbers), dtype=bool)
    last[:-1] = owner[1:] != owner[:-1]
    ends |= last
    stops = np.flatnonzero(ends)
    starts = np.concatenate([[0], stops[:-1] + 1])
    place = np.arange(len(numbers), dtype=np.uint64) - np.repeat(starts, stops - starts + 1).astype(np.uint64)
    body = np.add.reduceat(mixed(numbers + place * ODD_1), starts)
    whose = owner[stops]
    # equal paragraphs of a text are told apart by how many came before
    order = np.lexsort((body, whose))
    b, w = body[order], whose[order]
    new = np.ones(len(b), dtype=bool)
    new[1:] = (b[1:] != b[:-1]) | (w[1:] != w[:-1])
    run = np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))
    nth = (np.arange(len(b)) - run).astype(np.uint64)
    return mixed(b + nth * ODD_2), np.bincount(w, minlength=len(counts))


def _cells(digest: np.ndarray, base: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
    """The three cells of each digest, one in each part of its sketch."""
    return [base + k * part + (mixed(digest + STEPS[k]) % part.astype(np.uint64)).astype(np.int64) for k in range(3)]


def _check(digest: np.ndarray) -> np.ndarray:
    return mixed(digest ^ ODD_2)


def sketch(digest: np.ndarray, counts: np.ndarray, part: np.ndarray, sign: int = 1) -> list[np.ndarray]:
    """Count, digest sum and check sum of all cells; text i has ``3 * part[i]`` cells."""
    base = np.concatenate([[0], np.cumsum(3 * part)])
    out = [np.zeros(base[-1], dtype=np.int64), np.zeros(base[-1], dtype=np.uint64), np.zeros(base[-1], dtype=np.uint64)]
    owner = np.repeat(np.arange(len(counts)), counts)
    check = _check(digest)
    for at in _cells(digest, base[:-1][owner], part[owner]):
        np.add.at(out[0], at, sign)
        np.add.at(out[1], at, digest)
        np.add.at(out[2], at, check)
    return out


def peel(cells: list[np.ndarray], part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests found on the first and on the second side of each difference, and whether all were found."""
    n, total, check = (c.copy() for c in cells)
    base = np.concatenate([[0], np.cumsum(3 * part)])[:-1]
    owner = np.repeat(np.arange(len(part)), 3 * part)
    found = [np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)]
    while True:
        digest = np.where(n < 0, np.uint64(0) - total, total)
        pure = np.flatnonzero((np.abs(n) == 1) & (np.where(n < 0, np.uint64(0) - check, check) == _check(digest)))
        if not len(pure):
            break
        whose, one, sign = owner[pure], digest[pure], n[pure]
        # a digest that is alone in several cells is taken once
        order = np.lexsort((one, whose))
        whose, one, sign = whose[order], one[order], sign[order]
        new = np.ones(len(one), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (whose[1:] != whose[:-1])
        whose, one, sign = whose[new], one[new], sign[new]
        found[0] += np.bincount(whose[sign > 0], minlength=len(part))
        found[1] += np.bincount(whose[sign < 0], minlength=len(part))
        added = np.where(sign > 0, one, np.uint64(0) - one)
        added_check = np.where(sign > 0, _check(one), np.uint64(0) - _check(one))
        for at in _cells(one, base[whose], part[whose]):
            np.subtract.at(n, at, sign)
            np.subtract.at(total, at, added)
            np.subtract.at(check, at, added_check)
    left = np.bincount(owner, weights=(n != 0) | (total != 0) | (check != 0), minlength=len(part))
    return found[0], found[1], left == 0


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Shared over all paragraph digests for each pair of texts, from the peeled difference of their sketches."""
    (da, na), (db, nb) = a, b
    out = np.full(len(na), np.nan)
    todo, part = np.arange(len(na)), np.full(len(na), FIRST_CELLS)
    starts_a, starts_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    while len(todo):
        pick = lambda d, starts, n: d[np.repeat(starts[todo] - (np.cumsum(n[todo]) - n[todo]), n[todo]) + np.arange(n[todo].sum())]
        one = sketch(pick(da, starts_a, na), na[todo], part)
        two = sketch(pick(db, starts_b, nb), nb[todo], part)
        only_a, only_b, whole = peel([x - y for x, y in zip(one, two, strict=True)], part)
        both = na[todo] - only_a
        either = both + only_a + only_b
        out[todo[whole]] = np.where(either > 0, both / np.maximum(either, 1), 1.0)[whole]
        todo, part = todo[~whole], 2 * part[~whole]
    return out


def published(digest: np.ndarray, counts: np.ndarray) -> list[str]:
    """The fixed-size sketch of each text in hexadecimal, after its number of paragraphs."""
    part = np.full(len(counts), PUBLISHED_CELLS)
    n, total, check = sketch(digest, counts, part)
    packed = np.stack([n.astype(np.uint64), total, check >> np.uint64(32)], axis=1).astype("<u8").reshape(len(counts), -1)
    return [f"{c:x}-" + xxhash.xxh3_128_hexdigest(row.tobytes()) + row[::3].astype("<u4").tobytes().hex() + row[1::3].tobytes().hex() for c, row in zip(counts.tolist(), packed, strict=True)]


def versions(texts: list[bytes], edited: list[bytes], following: list[bytes]) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Fingerprints of texts and edited texts, and the likeness of each text to its edited text and to the next one."""
    own, other, after = digests(texts), digests(edited), digests(following)
    return published(*own), published(*other), likeness(own, other), likeness(own, after)


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, doc: str = "doc_id", text: str = "text", per_range: int = 4_000) -> DataFrame:
    """Every text, its edited text and the next document's text, compared through their sketches.

    The next document is the one with the next lower key; after the last comes the first. Documents
    go to ranges of keys that start at existing keys, sorted inside; the first document of each range
    is sent to the end of the range before as well, so that every document meets its next one in
    one pass that holds two texts. No text counts as an empty one; documents without a key come
    last; equal keys are ordered by the checksum of the text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[doc].dataType
    total = rows.count()
    ranges = max(1, -(-total // per_range))
    keys = rows.select("key").where(F.col("key").isNotNull())
    # existing keys at even ranks, and the highest; one per range
    bounds: list = sorted(
        {r.key for r in [keys.agg(F.max("key").alias("key")).first()] if r.key is not None}
        | set(keys.agg(F.expr(f"percentile_approx(key, {[i / ranges for i in range(1, ranges)]!r}, 100000)".replace("[", "array(").replace("]", ")")).alias("b")).first().b or [] if ranges > 1 else []),
        reverse=True,
    )
    n = max(1, len(bounds))
    rising = spark.sparkContext.broadcast(np.array(bounds[::-1]))

    @F.pandas_udf("to int, first boolean")
    def place(column):
        import pandas as pd

        known = column.notna().to_numpy()
        to, first = np.full(len(column), n - 1), np.full(len(column), len(rising.value) == 0)
        # range i holds the keys from the i-th bound (falling) down to just above the next one
        keys = column[known].to_numpy().astype(rising.value.dtype)
        at = np.searchsorted(rising.value, keys)
        to[known], first[known] = len(rising.value) - 1 - at, rising.value[np.minimum(at, len(rising.value) - 1)] == keys
        return pd.DataFrame({"to": to.astype(np.int32), "first": first})

    sorted_once = rows.withColumn("place", place("key")).select("key", "text", F.col("place.to").alias("at"), F.col("place.first").alias("first"))
    where = F.when(F.col("first"), F.array(F.struct(F.col("at").alias("to"), F.lit(0).alias("extra")), F.struct(F.pmod(F.col("at") - 1, F.lit(n)).cast("int").alias("to"), F.lit(1).alias("extra")))).otherwise(
        F.array(F.struct(F.col("at").alias("to"), F.lit(0).alias("extra")))
    )
    sent = sorted_once.withColumn("go", F.explode(where)).select("key", "text", "go.to", "go.extra", F.crc32(F.col("text").cast("binary")).alias("crc"))
    dealt = sent.repartitionById(n, F.col("to")).sortWithinPartitions("extra", F.col("key").desc_nulls_last(), "crc")
    schema = T.StructType(
        [T.StructField(doc, kind), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    )

    def compare(batches):
        def finish(part):
            texts = [a for _, a, _ in part]
            changed = [edit(a, b) for _, a, b in part]
            plain, other, near, far = versions([t.encode() for t in texts], [t.encode() for t in changed], [b.encode() for _, _, b in part])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _ in part], key_type),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array(plain, pa.string()),
                    pa.array(other, pa.string()),
                    pa.array(near, pa.float64()),
                    pa.array(far, pa.float64()),
                ],
                names=schema.names,
            )

        waiting, part, size, key_type, done = None, [], 0, None, False
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, t, extra in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if done:
                    break
                if waiting is not None:
                    part.append((*waiting, t))
                    size += len(waiting[1]) + len(t)
                    if size > 4_000_000:
                        yield finish(part)
                        part, size = [], 0
                waiting, done = (None, True) if extra else ((key, t), False)
        if part:
            yield finish(part)

    return dealt.select("key", "text", "extra").mapInArrow(compare, schema)
