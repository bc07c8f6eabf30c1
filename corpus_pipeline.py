"""A training corpus from ``documents``: quality rules, near-duplicates, decontamination, secrets, mix.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; ``run`` writes each result as Parquet in the shared folder and reads it back for the
next. All stages but the last return the columns of ``docs``; the last returns the documents
that the mix takes, with these columns, the words taken of each (repeats counted), its size, and
its source's size and target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkprism.llm import decontam, mixing, quality_rules, secret_scan, simhash
from talkprism.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.reject_repetitive(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_row_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
]

#: SQL expresses neither fingerprints nor seeds nor the mix; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
