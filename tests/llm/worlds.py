"""Small tables with the rows that break things: nulls, empty and long texts, copies, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, n long, shard string, row string, a string"


def words(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(1 + rng.randrange(3))) for _ in range(n)] if vocabulary == 0 else [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def messy_rows() -> list[tuple]:
    long = " ".join(words(7, 30_000, 0))
    texts = [
        (1, "One line of plain words, and a second.\nThen another line."),
        (2, None),
        (3, ""),
        (4, " \n\t  "),
        (5, long),
        (6, "Same text here, word for word, in two rows."),
        (6, "Same text here, word for word, in two rows."),
        (7, "Same text here, word for word, in two rows."),
        (None, "A row without a key but with a text of some words."),
        (None, None),
        (8, "Ünïcode straße 漢字かな 🙂 <|endoftext|> x y z İı"),
        (9, "x"),
        (10, "tabs\tand   runs \n\n\n of space  "),
    ]
    return [(k, t, "en", i, "s", "r", "z") for i, (k, t) in enumerate(texts)]


def messy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def table(spark: SparkSession, texts: dict) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
