"""A training corpus from raw documents, in five stages. Each stage works on what the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as Parquet and read again for the next one.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import decontaminate, near_copies, quality, sentencepiece_codec, substring
from vecspark.llm.common import new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive thresholds of their language and source."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document of least doc_id."""
    return near_copies.without_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words or more that an earlier document has."""
    return substring.without_repeats(docs)


def benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' ids, and whether they decode to the texts."""
    return sentencepiece_codec.encode(docs, keep=("lang", "source"))


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", benchmark_copies),
    ("token_ids", token_ids),
]

#: SimHash needs XXH64, and the last stage a tokenizer: SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
