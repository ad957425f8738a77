"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from peerlens.functions.ranking import scratch_dir  # noqa: E402
from peerlens.llm import mixing, packing, preference, secrets, simhash  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking puts below its cut go. All labels may be learned from; without both kinds all stay."""
    model = preference.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), one_sided="neutral")
    return preference.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.without_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to their kind in brackets; documents stay."""
    return secrets.redacted(docs, length_col="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their shares of tokens."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands among the training sequences."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("source mixing", mixture),
    ("best-fit packing", packed),
]

ORACLE_SQL = None  # training, fingerprints and the plan of bins are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_dir(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    for at, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
    return STAGES[-1][1](spark, docs, sf_dir)
