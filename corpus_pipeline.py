"""Training-corpus pipeline: quality rules, near-dedup, benchmark decontamination, PII, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from takeweave.llm import decontaminate, neardup, pack, pii, quality
from takeweave.session import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their group's thresholds go."""
    return quality.filtered(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return neardup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to the name of its kind."""
    return pii.redacted(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 2048."""
    return pack.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_dedup", dedup_stage),
    ("decontaminate", decontamination_stage),
    ("pii", pii_stage),
    ("pack", pack_stage),
]

#: Signatures, fingerprints and token ids cannot be told in SQL; tests/llm/test_brute_force.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
