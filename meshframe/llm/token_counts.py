"""Token counts: an exact histogram of encoded lengths.

Documents are counted by encoded length once. Suffix sums over the histogram,
whose rows are distinct lengths rather than documents, then answer totals,
quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import encoded, tokenizer_path
from .tables import stored


def lengths(documents: DataFrame, path: str | None = None, end: int = 1) -> DataFrame:
    """documents: doc_id, text (null: empty). Returns doc_id, length: the ids of the
    whole text plus ``end`` ids at its end. Repeated rows stay; other columns go."""
    path = path or tokenizer_path()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, n in encoded(batches, path):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n + end)], names=["doc_id", "length"])

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(kernel, "doc_id long, length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """A row per distinct length: length, n_docs, n_tokens; a stored table, as it is read
    more than once and its making encodes every text."""
    return stored(lengths.groupBy("length").agg(F.count("*").alias("n_docs"), F.sum("length").alias("n_tokens")))


def answers(hist: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """For every context limit that is a length in the histogram, or a row of ``limits``
    (length: any numbers): the documents and tokens that are longer, what is left when
    documents are cut at the limit, and the share of documents that fit (the quantile that
    the limit is). Null limits are left out; an empty histogram answers nothing.

    Cumulative sums run over blocks of lengths and then over block totals, so no
    task holds the whole histogram when lengths are many."""
    if limits is not None:
        zero = F.lit(0).cast("long")
        asked = limits.where("length is not null").select(F.col("length").cast("long").alias("length"), zero.alias("n_docs"), zero.alias("n_tokens"))
        hist = hist.unionByName(asked).groupBy("length").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    block = F.floor(F.col("length") / 4096).cast("long")
    rows = hist.withColumn("block", block)
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    up = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per 4096 lengths
    before = sums.select("block", F.coalesce(F.sum("bd").over(up), F.lit(0)).alias("d0"), F.coalesce(F.sum("bt").over(up), F.lit(0)).alias("t0"))
    total = sums.agg(F.sum("bd").alias("docs"), F.sum("bt").alias("tokens"))
    here = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    out = (
        rows.join(before, "block").join(F.broadcast(total))  # one row
        .withColumn("docs_up_to", F.col("d0") + F.sum("n_docs").over(here))
        .withColumn("tokens_up_to", F.col("t0") + F.sum("n_tokens").over(here))
    )
    longer = F.col("docs") - F.col("docs_up_to")
    return out.where("docs > 0").select(
        "length", "n_docs", "n_tokens", "docs_up_to", "tokens_up_to",
        longer.alias("docs_longer"), (F.col("tokens") - F.col("tokens_up_to")).alias("tokens_longer"),
        (F.col("tokens_up_to") + F.col("length") * longer).alias("tokens_truncated"),
        F.try_divide("docs_up_to", "docs").alias("quantile"),
    )


def quantile(hist: DataFrame, q: float) -> int | None:
    """The least length that at least the share q of all documents do not exceed."""
    row = answers(hist).where(F.col("quantile") >= q).agg(F.min("length")).first()
    return row[0]


def truncated_total(hist: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut after ``limit`` tokens."""
    row = hist.agg(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs"))).first()
    return row[0] or 0
