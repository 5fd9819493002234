"""Operator 6: exact token counts of whole texts by a two-tier lookup on the map side.

A table of the lengths of frequent pre-tokens is broadcast; its size is bound by
``table_size`` entries of at most ``longest`` characters. Every other pre-token is encoded
in the worker that meets it and kept in that worker's cache. Counts do not depend on what
the table or a cache holds, so nothing about the pre-tokens is shuffled: the table is filled
from a sample of about ``sample_rows`` documents, which changes speed alone.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionscore.llm.common import materialize, ship
from regionscore.llm.tokenizing import PieceLengths, split_pieces, tokenizer
from regionscore.llm.words import kept


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", sample_rows: int = 20_000, table_size: int = 65_536, longest: int = 32) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a sample; at most ``table_size`` of them."""
    rows = docs.count()
    if rows == 0:
        return {}
    sample = docs.select(F.col(text).alias("text"))
    if rows > sample_rows:
        sample = sample.sample(sample_rows / rows, seed=1)

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(p for p in (split_pieces(t) if t else None) or () if len(p) <= longest)
            if len(seen) > 4 * table_size:
                seen = Counter(dict(seen.most_common(2 * table_size)))
        best = seen.most_common(table_size)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in best], pa.string()), "n": pa.array([n for _, n in best], pa.int64())})

    counted = sample.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "frequent")
    # the least frequency at which all pieces still fit: few distinct frequencies, so a small table
    held, least = 0, None
    for row in counted.groupBy(F.least("n", F.lit(10_000)).alias("f")).count().orderBy(F.desc("f")).collect():
        held += row["count"]
        if held > table_size:
            break
        least = row.f
    if least is None:
        return {}
    pieces = [r.piece for r in counted.where(F.col("n") >= least).select("piece").collect()]
    library = tokenizer(path)
    return dict(zip(pieces, (len(e.ids) for e in library.encode_batch(pieces, add_special_tokens=False)), strict=True))


def token_counts(docs: DataFrame, path: str, text: str = "text", column: str = "n_tokens", **table) -> DataFrame:
    """``docs`` with the number of ids of each whole text in ``column`` (long).

    No text counts as an empty one: 0 tokens. Special-token strings inside a text are one id
    each, as the library reads them by default. A column of the same name is replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    rest = docs.drop(column)
    lengths = spark.sparkContext.broadcast(frequent_lengths(rest, path, text, **table))

    @F.pandas_udf("long")
    def n_tokens(texts):
        import pandas as pd

        counter = kept(("piece lengths", path, id(lengths.value)), lambda: PieceLengths(path, lengths.value))
        return pd.Series([counter(t) for t in texts], dtype="int64")

    return rest.withColumn(column, n_tokens(F.col(text)))
