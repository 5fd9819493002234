"""Operator 1: quality by importance resampling.

Two generative models over hashed n-grams, one of target text and one of all (raw) text, give
each document a log importance weight: the sum over its n-grams of the log ratio of the target's
count to the count that the raw model expects there, both plus ``PRIOR``, so that a rare n-gram
says little. A document's own n-grams are taken off both models first: without that, in a small
table, every document without a label would look unlike the target. N-grams are
words and word pairs, and pairs of word shapes (case, trailing marks, and whether the word
repeats the one before), so that a repetition or shouting is seen whatever the words are.
Documents are resampled without replacement by Gumbel top-k: the ``k`` largest sums of weight
and scaled Gumbel noise stay.

The raw model counts every document. The target model counts the documents labelled good and not
toxic, of at most ``label_rows`` labels (those with the smallest hash of their key); a toxic label
counts as bad whatever its quality.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionscore.llm.common import materialize, ship
from regionscore.llm.words import ODD_1, WordNumbers, kept, mixed, slices

WORD_BITS, SHAPE_BITS = 15, 14
#: Text whose n-grams a worker holds at one time, about.
STEP_BYTES = 500_000
#: Added to the observed and to the expected count of an n-gram.
PRIOR = 30.0
SPACE = (1 << WORD_BITS) + (1 << SHAPE_BITS)


def _shape(word: bytes) -> int:
    """Case of the letters and the marks at the end, in 9 bits."""
    text = word.decode("utf-8", "replace")
    core = text.rstrip("".join({c for c in text if not c.isalnum()})) if not text.isalnum() else text
    letters = core.lstrip("\"'([{¿¡«“‘")
    if not letters:
        case = 0
    elif letters.isdigit():
        case = 1
    elif letters.isupper() and len(letters) > 1:
        case = 2
    elif letters.islower():
        case = 3
    elif letters[:1].isupper() and (len(letters) == 1 or letters[1:].islower()):
        case = 4
    elif letters.isalpha():
        case = 5
    else:
        case = 6
    tail = text[len(core):]
    marks = 0 if not tail else 1 if tail in {".", ",", ";", ":", "?", "!", ")", "\"", "'"} else 2 + xxhash.xxh32_intdigest(tail.encode()) % 60
    return case * 64 + marks


def _number(word: bytes) -> int:
    core = word.lower().strip(b".,;:?!\"'()[]{}*%&#$|") or word
    return (xxhash.xxh64_intdigest(core) >> 9 << 9) | _shape(word)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the n-grams of all texts, and the text each belongs to."""
    numbers, counts = kept("shaped words", lambda: WordNumbers(_number)).of(texts, lower=False)
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    words, shapes = numbers >> np.uint64(9), numbers & np.uint64(511)
    inner = owner[1:] == owner[:-1]
    same = (words[1:] == words[:-1]).astype(np.uint64)
    pairs = mixed(words[:-1] * ODD_1 + words[1:])[inner]
    shape_pairs = mixed((shapes[:-1] << np.uint64(10)) + (shapes[1:] << np.uint64(1)) + same)[inner]
    singles = mixed(words)
    index = np.concatenate([
        (singles >> np.uint64(64 - WORD_BITS)).astype(np.int32),
        (pairs >> np.uint64(64 - WORD_BITS)).astype(np.int32),
        (shape_pairs >> np.uint64(64 - SHAPE_BITS)).astype(np.int32) + (1 << WORD_BITS),
    ])
    return index, np.concatenate([owner, owner[1:][inner], owner[1:][inner]])


@dataclass(frozen=True)
class ImportanceModel:
    """Counts of each n-gram index in raw and in target text, and the keys of the labelled documents."""

    raw: np.ndarray
    target: np.ndarray
    good: frozenset
    bad: frozenset = frozenset()

    @property
    def fitted(self) -> bool:
        return bool(self.target.any())

    def weights(self, index: np.ndarray, owner: np.ndarray, good: np.ndarray) -> np.ndarray:
        """The log importance weight of each text, its own n-grams left out of the counts."""
        out = np.zeros(len(good))
        if not self.fitted:
            return out
        words = index < (1 << WORD_BITS)
        for part, space in ((words, slice(0, 1 << WORD_BITS)), (~words, slice(1 << WORD_BITS, SPACE))):
            pair, times = np.unique(owner[part].astype(np.int64) * SPACE + index[part], return_counts=True)
            whose, gram = pair // SPACE, pair % SPACE
            size = np.bincount(whose, weights=times, minlength=len(good))
            mine = times * good[whose]
            target, raw = self.target[gram] - mine, self.raw[gram] - times
            totals = np.maximum(self.target[space].sum() - size * good, 0), np.maximum(self.raw[space].sum() - size, 1)
            expected = raw * (totals[0] / totals[1])[whose]
            ratio = np.log(np.maximum(target, 0) + PRIOR) - np.log(np.maximum(expected, 0) + PRIOR)
            out += np.bincount(whose, weights=ratio * times, minlength=len(good))
        return out


def fit(docs: DataFrame, labels: DataFrame, label_rows: int = 50_000, doc: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str = "toxic") -> ImportanceModel:
    """Count n-grams of all documents and of the ones labelled good (``quality`` = 1 and never ``toxic`` = 1 in all its labels)."""
    spark = docs.sparkSession
    ship(spark)
    harmful = F.coalesce(F.col(toxic) == 1, F.lit(False))
    known = labels.where(F.col(doc).isNotNull() & (F.col(quality).isin(0, 1) | harmful)).groupBy(F.col(doc).alias("key")).agg(F.min(F.when(harmful, 0).otherwise(F.col(quality))).alias("quality"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(label_rows).collect()
    bad = frozenset(r.key for r in chosen if r.quality == 0)
    good = spark.sparkContext.broadcast(frozenset(r.key for r in chosen if r.quality == 1))

    def count(batches):
        raw, target = np.zeros(SPACE, dtype=np.int64), np.zeros(SPACE, dtype=np.int64)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, texts in slices((t.as_py() for t in batch.column(1)), STEP_BYTES):
                index, owner = features(texts)
                raw += np.bincount(index, minlength=SPACE)
                wanted = np.fromiter((keys[first + i] in good.value for i in range(len(texts))), dtype=bool, count=len(texts))
                target += np.bincount(index[wanted[owner]], minlength=SPACE)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(some, pa.int32()), "raw": pa.array(raw[some]), "target": pa.array(target[some])})

    counted = docs.select(doc, F.col(text).cast("binary").alias("text")).mapInArrow(count, "gram int, raw long, target long")
    raw, target = np.zeros(SPACE), np.zeros(SPACE)
    for row in counted.groupBy("gram").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # at most SPACE rows
        raw[row.gram], target[row.gram] = row.raw, row.target
    return ImportanceModel(raw, target, good.value, bad)


def log_weight(spark, model: ImportanceModel, doc: str = "doc_id", text: str = "text") -> Column:
    """The log importance weight of a text, its number of n-grams and its label (-1: none), as a struct."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("log_weight double, n_features long, label int")
    def weigh(keys, texts):
        import pandas as pd

        weight, number = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        known = keys.tolist()
        for first, part in slices(texts, STEP_BYTES):
            index, owner = features(part)
            end = first + len(part)
            good = np.fromiter((k in sent.value.good for k in known[first:end]), dtype=bool, count=len(part))
            weight[first:end] = sent.value.weights(index, owner, good)
            number[first:end] = np.bincount(owner, minlength=len(part))
        label = np.array([1 if k in sent.value.good else 0 if k in sent.value.bad else -1 for k in known], dtype=np.int32)
        return pd.DataFrame({"log_weight": weight, "n_features": number, "label": label})

    return weigh(F.col(doc), F.col(text).cast("binary"))


def gumbel_key(weight: Column, key: Column, seed: int, scale: float) -> Column:
    """The weight plus Gumbel noise that a hash of the key decides."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return weight - F.lit(scale) * F.ln(-F.ln(u))


def kth_largest(table: DataFrame, column: str, k: int, parts: int = 4096) -> float | None:
    """The exact k-th largest value of a column, by counting in ever smaller intervals."""
    values = table.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    edge = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).first()
    if k <= 0 or edge.n == 0:
        return None
    if k >= edge.n:
        return edge.low
    low, high, rank, held = edge.low, edge.high, k, edge.n
    while low < high:
        if held <= parts:
            few = values.where(F.col("v").between(low, high)).groupBy("v").count().orderBy(F.desc("v")).collect()
            for row in few:
                rank -= row["count"]
                if rank <= 0:
                    return row.v
        step = (high - low) / parts
        if step <= 0 or low + step == low:
            few = values.where(F.col("v").between(low, high)).groupBy("v").count().orderBy(F.desc("v")).limit(parts).collect()
            for row in few:
                rank -= row["count"]
                if rank <= 0:
                    return row.v
        part = F.least(F.lit(parts - 1), F.floor((F.col("v") - low) / step).cast("int"))
        counts = values.where(F.col("v").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for row in counts.orderBy(F.desc("part")).collect():  # at most ``parts`` rows
            if rank <= row.n:
                low, high, held = row.low, row.high, row.n
                break
            rank -= row.n
    return low


def least_mean(table: DataFrame) -> float:
    """The mean weight of an n-gram above which labelled documents are told apart best, to a thousandth.

    Sensitivity and specificity count alike; among equally good places the middle of the widest
    stretch is taken. Without labels of both kinds it is 0.
    """
    mean = F.col("log_weight") / F.col("n_features")
    step = F.greatest(F.lit(-20_000), F.least(F.lit(20_000), F.floor(mean * 1000))).cast("int")
    rows = table.where((F.col("label") >= 0) & (F.col("n_features") > 0)).groupBy(step.alias("step"), "label").count().collect()  # at most 80,002
    good, bad = np.zeros(40_002), np.zeros(40_002)
    for row in rows:
        (good if row.label else bad)[row.step + 20_000] += row["count"]
    if not good.any() or not bad.any():
        return 0.0
    # at place i, everything below step i is rejected
    passed = good[::-1].cumsum()[::-1] / good.sum() + np.concatenate([[0], bad.cumsum()[:-1]]) / bad.sum()
    best = np.flatnonzero(passed >= passed.max() - 1e-12)
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    widest = max(runs, key=len)
    return float((widest[0] + widest[-1]) // 2 - 20_000) / 1000


def resample(docs: DataFrame, model: ImportanceModel, k: int | None = None, seed: int = 11, scale: float = 0.05, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, float | None, float]:
    """Weights and decisions of all documents, the key a document needs to stay, and the ``least_mean``.

    Columns: the document, ``n_features``, ``log_weight``, ``gumbel_key``, ``keep``. The weight of
    each n-gram is taken relative to :func:`least_mean`. ``k`` is the number to draw; by default
    as many as have a weight above 0. Documents whose key equals the k-th all stay. A text without
    words has no key and does not stay; without target labels all documents with words stay.
    """
    scored = docs.select(F.col(doc), log_weight(docs.sparkSession, model, doc, text).alias("_w"))
    raw = materialize(scored, "importance")
    key, needed, least = _drawn(raw, model, k, seed, scale, doc)
    keep = F.coalesce(key >= F.lit(needed), F.lit(False)) if needed is not None else F.lit(False)
    weight = F.col("_w.log_weight") - F.lit(least) * F.col("_w.n_features")
    return raw.select(doc, "_w.n_features", weight.alias("log_weight"), key.alias("gumbel_key"), keep.alias("keep")), needed, least


def _drawn(raw: DataFrame, model: ImportanceModel, k: int | None, seed: int, scale: float, doc: str) -> tuple[Column, float | None, float]:
    """The Gumbel key of each row of a stored table with weights ``_w``, the k-th largest key, and the ``least_mean``."""
    least = least_mean(raw.select("_w.*"))
    weight, size = F.col("_w.log_weight") - F.lit(least) * F.col("_w.n_features"), F.col("_w.n_features")
    key = F.when(size > 0, gumbel_key(weight, F.col(doc), seed, scale))
    if k is None:
        wanted = raw.where(size > 0)
        k = wanted.where(weight > 0).count() if model.fitted else wanted.count()
    return key, kth_largest(raw.select(key.alias("gumbel_key")), "gumbel_key", k), least


def keep_good(docs: DataFrame, labels: DataFrame, label_rows: int = 50_000, seed: int = 11, scale: float = 0.05, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the resampling draws, with their columns unchanged.

    Rows with equal or without keys are weighed and drawn like any others. A column ``_w`` of ``docs`` is left out.
    """
    spark = docs.sparkSession
    model = fit(docs, labels, label_rows, doc, text)
    # weighed again for the rows that stay: a table of the texts beside their weights would lie in the shared folder until the end
    _, needed, least = resample(docs, model, None, seed, scale, doc, text)
    if needed is None:
        return docs.limit(0)
    weighed = docs.drop("_w").select("*", log_weight(spark, model, doc, text).alias("_w"))
    key = gumbel_key(F.col("_w.log_weight") - F.lit(least) * F.col("_w.n_features"), F.col(doc), seed, scale)
    return weighed.where((F.col("_w.n_features") > 0) & (key >= F.lit(needed))).drop("_w")
