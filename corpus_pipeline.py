"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a frame; callers may
store a stage's result as Parquet and hand it to the next. All stages but the last return the
columns of their docs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from mercadia.llm import near_duplicates, packing, positional_index, quality_rules, site_quality
from mercadia.llm.queries import tokenizer_file
from mercadia.llm.shared import Tables


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality_rules.kept_documents(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that text, path and host together call good."""
    return site_quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_duplicates.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return positional_index.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.placement(packing.packed(docs, tokenizer_file(), separator_id=0))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Tokens, signatures and a fitted classifier can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is stored and read again."""
    tables = Tables(spark, "pipeline")

    def apply(docs: DataFrame, stage) -> DataFrame:
        found = stage[1](spark, docs, sf_dir)
        return found if stage is STAGES[-1] else tables.stored(found)

    return reduce(apply, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
