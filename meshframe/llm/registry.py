"""Queries of this subpackage, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, katz, license_scan, minhash_dedup, ngram_join, oracles, packing, prefix_trie, quality_rules, substring_dedup, token_counts, toxicity, url_filter
from .tables import documents


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(documents(spark, sf_dir), order=katz.ORDER)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.matches(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.answers(token_counts.histogram(token_counts.lengths(documents(spark, sf_dir))))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judged(documents(spark, sf_dir), labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("bad")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed(documents(spark, sf_dir))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(documents(spark, sf_dir))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    out = url_filter.judge(pages, labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.joined(documents(spark, sf_dir))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    """The others learn, or encode with a tokenizer; tests hold them against plain versions."""
    return {
        "op2_ngram_jaccard_join": oracles.OP2,
        "op7_benchmark_decontamination": oracles.OP7,
        "op9_substring_dedup": oracles.OP9,
        "op10_url_filters": oracles.op10(),
        "op11_conversation_prefix_trie": oracles.OP11,
        "op12_minhash_near_dedup": oracles.OP12,
        "op13_filter_interaction_audit": oracles.OP13,
    }
