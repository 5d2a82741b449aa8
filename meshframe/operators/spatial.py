"""Spatial search as joins: nearest neighbours, closest points and rays go down a tree of
boxes, radius and box joins meet on grid cells; the exact test follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import Vec, field, nearest_in_face, ray_hit
from ..schema import MeshFrame
from ..sources.meshes import corner_vecs, corners
from . import tree
from .measure import boxes_overlap


def cell(width: float) -> list[Column]:
    return [F.floor(F.col(a) / width).alias(f"c{a}") for a in "xyz"]


def _around(queries: DataFrame, width: float) -> DataFrame:
    """Queries on their own cell and the 26 about it."""
    q = queries.select("*", *cell(width))
    for a in "xyz":
        q = q.withColumn(f"c{a}", F.explode(F.array(*[F.col(f"c{a}") + d for d in (-1, 0, 1)])))
    return q


def radius_join(queries: DataFrame, points: DataFrame, squared: float) -> DataFrame:
    """queries: qid, x, y, z; points: vid, x, y, z. Pairs nearer than the root of
    ``squared``: qid, vid, d2. Cells are as wide as the radius."""
    width = squared**0.5
    q = _around(queries.select("qid", *Vec.of().columns()), width).withColumnsRenamed({a: f"q{a}" for a in "xyz"})
    p = points.select("vid", *Vec.of().columns(), *cell(width))
    d2 = (Vec.of() - Vec.of("q")).norm2()
    return q.join(p, ["cx", "cy", "cz"]).select("qid", "vid", d2.alias("d2")).where(F.col("d2") < squared)


def nearest(queries: DataFrame, points: DataFrame, n: int = 1, leaf: int = tree.LEAF) -> DataFrame:
    """The n nearest points of each query by (d2, vid): qid, k (from 1), vid, d2; fewer where
    there are not so many. Points without a position are left out.

    Points of one position are one item of the tree with its n least vids, so a position
    that many points share is one row."""
    p = points.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z"))).select("vid", *Vec.of().columns())
    least = p.withColumn("k", F.row_number().over(Window.partitionBy("x", "y", "z").orderBy("vid"))).where(F.col("k") <= n)
    items = least.groupBy("x", "y", "z").agg(F.collect_list("vid").alias("vids"))
    found = tree.nearest_items(queries, tree.build(items, Vec.of(), Vec.of(), leaf), lambda: F.struct((Vec.of() - Vec.of("q")).norm2().alias("d2")), n)
    each = found.select("qid", "d2", F.explode("vids").alias("vid"))
    return each.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("d2", "vid"))).where(F.col("k") <= n).select("qid", "k", "vid", "d2")


def face_tree(mesh: MeshFrame, leaf: int = tree.LEAF) -> tree.Tree:
    """Faces with the positions of their corners, by their boxes."""
    low, high = (Vec(*(f(*[f"{a}{k}" for k in range(3)]) for a in "xyz")) for f in (F.least, F.greatest))
    return tree.build(corners(mesh.vertices, mesh.faces), low, high, leaf, by_size=True)


def closest_surface_point(queries: DataFrame, mesh: MeshFrame, leaf: int = tree.LEAF) -> DataFrame:
    """The nearest point of the surface to each query, over all faces: qid, fid, part, d2,
    x, y, z; equal distances give the least fid."""
    met = tree.nearest_items(queries, face_tree(mesh, leaf), lambda: nearest_in_face(Vec.of("q"), *corner_vecs()))
    best = met.groupBy("qid").agg(F.min(F.struct("d2", "fid", "part", "x", "y", "z")).alias("b"))
    return best.select("qid", "b.fid", "b.part", "b.d2", "b.x", "b.y", "b.z")


def _ray_meets(box: Column) -> Column:
    """Does the ray from x, y, z along ux, uy, uz meet a box (a struct lx .. hz)?"""
    slack = F.greatest(*[F.greatest(F.abs(box[f"l{a}"]), F.abs(box[f"h{a}"]), F.abs(F.col(a))) for a in "xyz"]) * 1e-12
    enter, leave = F.lit(0.0), F.lit(float("inf"))
    for a in "xyz":
        low, high, u = box[f"l{a}"] - slack - F.col(a), box[f"h{a}"] + slack - F.col(a), F.col(f"u{a}")
        p, q = F.try_divide(low, u), F.try_divide(high, u)
        enter = F.greatest(enter, F.when(u != 0, F.least(p, q)).otherwise(F.when((low <= 0) & (high >= 0), 0.0).otherwise(float("inf"))))
        leave = F.least(leave, F.when(u != 0, F.greatest(p, q)).otherwise(float("inf")))
    return (enter <= leave * (1 + 1e-12)) & (enter < float("inf"))


def ray_cast(rays: DataFrame, mesh: MeshFrame, leaf: int = tree.LEAF) -> DataFrame:
    """rays: qid, x, y, z, ux, uy, uz (a direction of any length). The first face that each
    ray meets: qid, fid, t (in lengths of u) and the place; rays that miss give no row."""
    met = tree.down(rays.select("qid", *Vec.of().columns(), *Vec.of("u").columns("u")), faces := face_tree(mesh, leaf), _ray_meets)
    met = met.withColumnsRenamed({a: f"o{a}" for a in "xyz"}).join(faces.items, "leaf")
    t = ray_hit(Vec.of("o"), Vec.of("u"), *corner_vecs())
    hits = met.select("qid", t.alias("t"), "fid", *(Vec.of("o") + Vec.of("u") * t).columns()).where("t is not null")
    return hits.groupBy("qid").agg(F.min(F.struct("t", "fid", "x", "y", "z")).alias("b")).select("qid", "b.fid", "b.t", "b.x", "b.y", "b.z")


def overlapping_boxes(boxes: DataFrame) -> DataFrame:
    """boxes: id, min_x .. max_z. Pairs a < b that meet.

    Cells come in levels, each twice as wide as the one below. A box stands on the level of
    its own size, where it touches few cells whatever its size, and looks for others there
    and on each level above that has boxes. A pair counts on the first cell of its common
    part only, on the level of the larger one."""
    size = F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"])
    b = boxes.select("id", *[f"{m}_{a}" for a in "xyz" for m in ("min", "max")], F.when(size > 0, F.ceil(F.log2(size))).cast("int").alias("level"))
    levels = sorted(r["level"] for r in b.where("level is not null").select("level").distinct().collect())  # powers of two, so a few hundred at most
    b = b.withColumn("level", F.coalesce("level", F.lit(levels[0] if levels else 0)))
    wide = lambda level: F.pow(F.lit(2.0), level)

    def on_cells(df: DataFrame, level: str) -> DataFrame:
        for a in "xyz":
            df = df.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"min_{a}") / wide(F.col(level))), F.floor(F.col(f"max_{a}") / wide(F.col(level))))))
        return df

    up = F.filter(F.array(*[F.lit(k) for k in levels or [0]]), lambda k: k >= F.col("level"))
    p = on_cells(b.withColumn("up", F.explode(up)), "up").alias("p")
    q = on_cells(b, "level").alias("q")
    on = [F.col("p.up") == F.col("q.level"), *[F.col(f"p.c{a}") == F.col(f"q.c{a}") for a in "xyz"]]
    once = (F.col("p.level") < F.col("q.level")) | (F.col("p.id") < F.col("q.id"))
    for a in "xyz":
        once = once & (F.col(f"q.c{a}") == F.floor(F.greatest(f"p.min_{a}", f"q.min_{a}") / wide(F.col("q.level"))))
    met = p.join(q, on).where((F.col("p.id") != F.col("q.id")) & once & boxes_overlap("p", "q"))
    return met.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"))


def aligned_faces(points: DataFrame, mesh: MeshFrame) -> DataFrame:
    """points: qid, vid, x, y, z (where to look). Of the faces of a vertex, the one whose
    plane direction from the vertex is best aligned with the other point: qid, fid."""
    f = corners(mesh.vertices, mesh.faces)
    a, b, c = corner_vecs()
    mid = ((a + b + c) * (1 / 3)).struct().alias("mid")
    flat = f.select("fid", mid, F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    at = mesh.vertices.select("vid", *Vec.of().columns("v"))
    j = points.join(flat, "vid").join(at, "vid")
    score = (field(F.col("mid")) - Vec.of("v")).unit().dot((Vec.of() - Vec.of("v")).unit())
    return j.select("qid", "fid", score.alias("s")).groupBy("qid").agg(F.max(F.struct("s", (-F.col("fid")).alias("m"))).alias("b")).select("qid", (-F.col("b.m")).alias("fid"))
