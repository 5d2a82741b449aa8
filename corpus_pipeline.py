"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Stages work on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.llm import decontaminate, ngram_join, packing, quality_rules, substring_dedup
from meshframe.llm.tables import discard, documents, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base checks nor the learnt rules reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.kept(docs, labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("bad")))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return ngram_join.one_of_each(docs, size=5, least=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of 50 words that a document of a smaller id has, too. A document
    that loses all its words goes."""
    return substring_dedup.deduplicated(docs, length=50).where(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: where it stands in its document and in its sequence."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the learnt rules, nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as a table and read again; a stage's table
    goes when the next one's is there."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            if k:
                discard(last)
    return docs
