"""Meshes made from the test tables by formula, and small literal meshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import FACES, VERTICES, MeshFrame
from .sources.meshes import height_map, used_vertices


def height() -> Column:
    """The mean price of a group, in thousands. Doubles added in another order give another
    last digit, and a height between two rounded ones would be two vertices where a plan
    reads the table twice; so prices are added as decimals, whose sum has no order. Values
    that are no decimals (NaN, infinite, beyond 20 digits) are averaged as they are."""
    price = F.col("l_extendedprice")
    exact = price.try_cast("decimal(28,8)")
    mean = F.try_divide(F.sum(exact).cast("double"), F.count(price))
    return F.when(F.count(exact) == F.count(price), mean).otherwise(F.avg(price)) / 1000


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    i, j = F.round(F.col("l_discount") * 100).cast("int"), F.col("l_quantity").cast("int")
    return l.groupBy(i.alias("i"), j.alias("j")).agg(height().alias("z"))


def grid(spark: SparkSession, sf_dir: str, keep=None, winding: str = "reference") -> MeshFrame:
    """The height map of lineitem; ``keep``, a boolean Column on i and j, drops cells."""
    cells = grid_cells(spark, sf_dir)
    return height_map(cells if keep is None else cells.where(keep), winding=winding)


def terrain(spark: SparkSession, sf_dir: str) -> MeshFrame:
    """A height map that grows with the table: 40 orders a row of cells, quantities along it."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    i, j = F.floor(F.col("l_orderkey") / 40).cast("int"), F.col("l_quantity").cast("int")
    return height_map(l.groupBy(i.alias("i"), j.alias("j")).agg(height().alias("z")))


def perforated(spark: SparkSession, sf_dir: str) -> MeshFrame:
    return grid(spark, sf_dir, (F.col("i") * 31 + F.col("j") * 17) % 11 != 0)


def strips(spark: SparkSession, sf_dir: str) -> MeshFrame:
    return grid(spark, sf_dir, ~F.col("j").isin(24, 25))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: mesh_id (label), vid, x, y, z."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = [F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")]
    return e.select(F.col("label").cast("bigint").alias("mesh_id"), F.col("vec_id").cast("bigint").alias("vid"), *at)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query points over the grid: the first 40 embeddings, as the SQL has them."""
    return all_probes(spark, sf_dir).where("qid < 40")


def all_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query points over the grid: every embedding, scaled into its box."""
    p = points(spark, sf_dir)
    return p.select(F.col("vid").alias("qid"), (F.col("x") * 40 + 25).alias("x"), (F.col("y") * 8 + 5).alias("y"), (F.col("z") * 20 + 50).alias("z"))


#: Fixed values: (vertices, faces) by name.
LITERAL = {
    "triangle": ([(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)]),
    "square": ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [(0, 1, 2), (0, 2, 3)]),
    "tetrahedron": ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)]),
    "cube": (
        [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)],
        [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)],
    ),
    "book": ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, -1, 0.1), (0, 0, 1)], [(0, 1, 2), (1, 0, 3), (0, 1, 4)]),
    "bowtie": ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0)], [(0, 1, 2), (0, 3, 4)]),
    "moebius": ([(1, 0, 0), (0.3, 1, 0.2), (-0.8, 0.6, 0.4), (-0.8, -0.6, 0.6), (0.3, -1, 0.8)], [(k, (k + 1) % 5, (k + 2) % 5) for k in range(5)]),
    "ring": ([(0, 0, 0), (3, 0, 0), (3, 3, 0), (0, 3, 0), (1, 1, 0), (2, 1, 0), (2, 2, 0), (1, 2, 0)], [f for k in range(4) for f in ((k, (k + 1) % 4, 4 + (k + 1) % 4), (k, 4 + (k + 1) % 4, 4 + k))]),
}


def literal(spark: SparkSession, *names: str) -> MeshFrame:
    """Some literal meshes as one bundle; mesh_id is the place of the name in LITERAL."""
    order = list(LITERAL)
    v = [(order.index(n), k, *map(float, p)) for n in names for k, p in enumerate(LITERAL[n][0])]
    f = [(order.index(n), k, *t) for n in names for k, t in enumerate(LITERAL[n][1])]
    return MeshFrame(spark.createDataFrame(v, VERTICES), spark.createDataFrame(f, FACES))


def faces_of(mesh: MeshFrame, keep) -> MeshFrame:
    f = mesh.faces.where(keep)
    return mesh.with_(faces=f, vertices=used_vertices(mesh.vertices, f))
