"""Points that arrive as a stream: vertex identity kept up by watermarked micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.meshes import keys


def cells(stream: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """stream: ts, mesh_id, x, y, z. Per window of time and rounded position: how many
    points came and their mean. Later than ``delay``, points are left out."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "mesh_id", *keys()).agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in "xyz"])


def new_vertices(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first point of each rounded position within the watermark."""
    return stream.withWatermark("ts", delay).select("ts", "mesh_id", "x", "y", "z", *keys()).dropDuplicatesWithinWatermark(["mesh_id", "qx", "qy", "qz"])
