"""The corpus pipeline: STAGES applied in order to ``documents``.

Every stage takes what its predecessor kept and returns the columns of ``documents``;
the last one encodes the mixture.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from certloom.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality, queries
from certloom.llm.common import read_table, scratch_folder, tune


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking does not reject."""
    tune(spark)
    return quality.keep_good(docs, queries.quality_ranking(docs, read_table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    tune(spark)
    return near_dedup.keep_one(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' weights ask for."""
    return mixing.mix(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture, with the digests of a round trip."""
    tune(spark)
    path, pattern = public_tokenizers.path(queries.BYTE_BPE), public_tokenizers.PATTERN
    return byte_bpe.round_trip(docs, path, pattern)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", source_mixture),
    ("byte_bpe", encoding),
]

#: Training, near-duplicate groups and merges by rank have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
