"""A training corpus from `documents`: the operators of plumeline.llm as stages, each written and read again.

STAGES: functions of (spark, docs, sf_dir); all but the last return the columns of
documents. run(spark, sf_dir) applies them to the documents table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumeline.llm import decontamination, minhash, packing, quality, secrets
from plumeline.llm.common import Scratch, cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; every document stays."""
    return secrets.redacted(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sequence_packing", sequence_packing),
]

#: Distances, winnowing and tokens can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; what each keeps is in the shared folder until the last one is done."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as keep:
        for _, stage in STAGES[:-1]:
            docs = keep(stage(spark, docs, sf_dir))
        return cut(STAGES[-1][1](spark, docs, sf_dir))
