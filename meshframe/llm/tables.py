"""Tables that operators read, and tables they write to cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.iterate import discard, settings, shared_folder, stored

__all__ = ["discard", "documents", "quoted", "settings", "shared_folder", "stored", "tasks"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quoted(name: str) -> str:
    """A column name, whatever it holds, as part of an expression."""
    return "`" + name.replace("`", "``") + "`"


def tasks(spark: SparkSession, rows: int, each: int = 20_000) -> int:
    """Tasks for a shuffle whose work grows with ``rows``: the session's number, and more
    where a task would get over ``each`` of them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
