"""The operators applied to the whole of their tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import (
    byte_bpe, chunking, decontam, fingerprints, html_text, mixing, near_dup, pii, prefix_trie, resampling, suffixes, toxicity, word_runs,
)
from seriesloom.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


@query
def op3_benchmark_matches(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_repeated_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.repeated_spans(table(spark, folder, "documents"))


@query
def op5_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, folder, "documents"))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), words_each=2)


@query
def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, folder, "documents"))


@query
def op9_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.drawn(table(spark, folder, "documents"), table(spark, folder, "labels"))[0]


@query
def op10_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_pages(table(spark, folder, "pages"))


@query
def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


@query
def op12_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = word_runs.word_runs(word_runs.with_repeated_tail(table(spark, folder, "documents")))
    best = word_runs.strongest(F.col("runs"))
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(word_runs.listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = byte_bpe.vocabulary()
    back = byte_bpe.decode(byte_bpe.encode(table(spark, folder, "documents"), ranks, pattern), ranks)
    return back.select(
        "doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
