"""The training-data pipeline: each stage works on all its predecessor kept.

Quality rules drop what they reject, the n-gram join keeps one document of each group, benchmark
decontamination drops documents that contain test items, secret scans mask live-looking
credentials, and packing returns the sequences. No stage is expressed in SQL.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablesync.llm import decontaminate, ngram_join, packing, quality_rules, secret_scan
from tablesync.llm.common import documents, ship_package, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep(docs, quality_rules.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ngram_join.keep_one(docs, ngram_join.Threshold(words=5, num=80, den=100))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
