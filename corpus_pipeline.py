"""From raw documents to packed training sequences, one stage after another.

Each stage works on all rows that the one before kept; its result is written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from regionscore.llm.common import materialize
from regionscore.llm.decontaminate import keep_clean
from regionscore.llm.importance import keep_good
from regionscore.llm.jaccard_join import keep_one
from regionscore.llm.packing import pack
from regionscore.llm.surrogates import replace_entities


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws, by the labels of the corpus."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8), the one with the least id."""
    return keep_one(docs, width=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data."""
    return replace_entities(docs, key="corpus-2024", counted=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of 4096."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("deduplicate", deduplicate),
    ("decontaminate", decontaminate),
    ("pseudonymise", pseudonymise),
    ("packing", packing),
]

#: SQL cannot express the classifier, the keyed surrogates or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
