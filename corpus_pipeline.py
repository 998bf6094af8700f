"""Documents through quality rules, near-duplicate removal, decontamination, masking of personal data and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm.common import settle
from lacuna.llm.decontam import decontaminate
from lacuna.llm.nearcopies import keep_one_of_group
from lacuna.llm.packing import pack_documents
from lacuna.llm.pii import mask_personal_data
from lacuna.llm.quality import keep_good


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash links completed to all pairs with a Jaccard similarity of 0.8 or more over
    five-word shingles), the document with the smallest id stays (null ids come last, then the first row)."""
    return keep_one_of_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; no document goes."""
    return mask_personal_data(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of the remaining documents gets a place in a training sequence."""
    return pack_documents(docs)


STAGES = [("quality", quality_stage), ("near-duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("personal-data", personal_data_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
