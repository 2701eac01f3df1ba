"""The corpus pipeline: documents through five operators, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import decontam, mixing, near_dup, pii, resampling
from seriesloom.llm.tables import table
from seriesloom.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return resampling.keep_drawn(docs, table(spark, folder, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return near_dup.one_of_each_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, folder, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return pii.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return mixing.mix(docs).filter("copies > 0")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing_sources),
]

ORACLE_SQL = None  # models, sketches and searches have no SQL form


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
