"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame,
which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factlake.llm.common import cut, drop, ready
from factlake.llm.decontaminate import decontaminated
from factlake.llm.jaccard import deduplicated
from factlake.llm.langid import identified
from factlake.llm.packing import pack
from factlake.llm.secrets import without_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go.

    Null and empty texts and texts without a letter go, and those whose two nearest languages tie or nearly so; without
    any labelled document all go. Repeated rows are all judged alike; columns of any name stay.
    """
    ready(spark)
    return identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, the one with the smallest doc_id.

    Null and empty texts and rows with a null doc_id stay; rows that repeat the smallest doc_id all stay; columns of any name stay.
    """
    ready(spark)
    return deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts stay, and all documents if the benchmark is empty; items without words match nothing;
    repeated rows go or stay together; columns of any name stay.
    """
    ready(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are redacted; every document stays, with its columns, whatever they are called.

    Null and empty texts stay as they are; n_chars is brought up to date where a text changed; spans that overlap are redacted as one.
    """
    return without_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences.

    A null or empty text is its end id alone; repeated rows and null doc_ids each get their own place; further columns are left out.
    """
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: language ID and packing are beyond SQL; tests/llm/test_pipeline.py compares each stage and run() with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if written is not None:
            drop(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
