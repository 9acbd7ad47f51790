"""From raw documents to token ids: five stages, each one of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import bpe, decontamination, quality_rules, simhash, suffix_dedup
from tracemill.llm.common import materialise

STAGES = [
    ("quality rules", quality_rules.rejecting_stage),
    ("near duplicates", simhash.dedup_stage),
    ("repeated passages", suffix_dedup.dedup_stage),
    ("decontamination", decontamination.decontaminating_stage),
    ("token ids", bpe.encode_stage),
]

#: SQL can't express the later stages; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
