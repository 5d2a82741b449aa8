"""Ways over a surface between any two points, and visits of its faces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import Vec
from ..plans.iterate import discard, stored
from ..schema import MeshFrame
from ..sources.meshes import corners
from . import graph, routes, tree
from .spatial import closest_surface_point, face_tree, nearest
from .topology import EDGE, half_edges


def surface_paths(queries: DataFrame, mesh: MeshFrame) -> DataFrame:
    """queries: qid, x0, y0, z0, x1, y1, z1; a bundle of one mesh. The shortest way along
    edges from the vertex nearest to the first point to the one nearest to the second, with
    its ends trimmed: where the face on which a point lies has the first edge of the way,
    the point on the face stands for the first vertex, and likewise at the end. Rows qid,
    pos, x, y, z; a way of one vertex is the straight line between the two points on the
    surface, and points that no way joins give no rows. ``graph.path_lengths`` measures it."""
    q = queries.select("qid", *[F.col(f"{a}{k}").cast("double") for k in (0, 1) for a in "xyz"])
    ends = [q.select((F.col("qid") * 2 + k).alias("qid"), *[F.col(f"{a}{k}").alias(a) for a in "xyz"]) for k in (0, 1)]
    ends = stored(ends[0].unionByName(ends[1]))
    at = nearest(ends, mesh.vertices).select("qid", "vid")
    on = closest_surface_point(ends, mesh).select("qid", "fid", "x", "y", "z")
    at = stored(at.join(on, "qid"))
    side = lambda k, v, f, p: at.where(F.pmod("qid", F.lit(2)) == k).select(((F.col("qid") - k) / 2).cast("bigint").alias("qid"), F.col("vid").alias(v), F.col("fid").alias(f), *Vec.of().columns(p))
    both = stored(side(0, "src", "f0", "a").join(side(1, "dst", "f1", "b"), "qid").join(mesh.vertices.select("mesh_id", F.col("vid").alias("src")), "src"))
    pairs = both.select("mesh_id", "src", "dst").distinct()
    chain = graph.paths(routes.routes(mesh, pairs)[1], pairs)
    last = chain.groupBy("src", "dst").agg(F.max("back").alias("n"))
    walk = stored(both.join(chain.drop("mesh_id"), ["src", "dst"]).join(last, ["src", "dst"]).withColumn("pos", F.col("n") - F.col("back")))
    # the first and the last edge of each way, and whether the points' faces have them
    pick = lambda c, k: F.max(F.when(F.col(c) == k, F.col("vid")))
    tips = walk.groupBy("qid", "f0", "f1").agg(pick("pos", 0).alias("s0"), pick("pos", 1).alias("s1"), pick("back", 0).alias("e0"), pick("back", 1).alias("e1"))
    face = lambda f, name: mesh.faces.select(F.col("fid").alias(f), F.array("v0", "v1", "v2").alias(name))
    has = lambda c, a, b: F.array_contains(c, F.col(a)) & F.array_contains(c, F.col(b))
    tips = tips.join(face("f0", "c0"), "f0").join(face("f1", "c1"), "f1").select("qid", F.coalesce(has("c0", "s0", "s1"), F.lit(False)).alias("t0"), F.coalesce(has("c1", "e0", "e1"), F.lit(False)).alias("t1"))
    way = walk.where("n > 0").join(tips, "qid").join(mesh.vertices.select("vid", "x", "y", "z"), "vid")
    place = lambda a: F.when((F.col("pos") == 0) & F.col("t0"), F.col(f"a{a}")).when((F.col("back") == 0) & F.col("t1"), F.col(f"b{a}")).otherwise(F.col(a)).alias(a)
    way = way.select("qid", "pos", *[place(a) for a in "xyz"])
    short = walk.where("n = 0")
    for k, p in ((0, "a"), (1, "b")):
        way = way.unionByName(short.select("qid", F.lit(k).cast("bigint").alias("pos"), *[F.col(f"{p}{a}").alias(a) for a in "xyz"]))
    return way


_TRACE = "mesh_id long, qid long, side int, fid long, a long, b long, x double, y double, z double, length double, n int, f0 long, f1 long, gx double, gy double, gz double, most long"
_FACE = [*[f"v{k}" for k in range(3)], *[f"{a}{k}" for k in range(3) for a in "xyz"], *[f"o{k}" for k in range(3)], "nx", "ny", "nz"]


def _trace(table: pa.Table) -> pa.Table:
    """The faces of one cell and the traces in it: each trace goes on until it leaves the
    cell (with the face that it enters), arrives (b is -2) or ends (left out)."""
    names = [x.split()[0] for x in _TRACE.split(", ")]
    rows = table.to_pylist()
    faces = {r["fid"]: r for r in rows if r["kind"] == 0}
    out = []
    for r in (r for r in rows if r["kind"] == 1):
        x, length, n, fid, over = np.array([r[c] for c in "xyz"]), r["length"], r["n"], r["fid"], (r["a"], r["b"])
        while fid in faces and fid != r["f1"]:
            face = faces[fid]
            at = [np.array([face[f"{c}{k}"] for c in "xyz"]) for k in range(3)]
            if face["nx"] is None or n > r["most"]:
                fid = None
                break
            height = [float(np.dot([face["nx"], face["ny"], face["nz"]], p - x)) for p in at]
            cut = [k for k in range(3) if (height[k] < 0) != (height[(k + 1) % 3] < 0)]  # edge k joins corners k and k + 1
            sides = [{face[f"v{k}"], face[f"v{(k + 1) % 3}"]} for k in range(3)]
            if over[0] is not None:  # on through the face, never back over the edge it came by
                cut = [k for k in cut if sides[k] != set(over)] if any(sides[k] == set(over) for k in cut) else []
            if len(cut) <= (r["side"] if over[0] is None else 0):
                fid = None
                break
            k = cut[r["side"] if over[0] is None else 0]
            p, q, h = at[k], at[(k + 1) % 3], (height[k], height[(k + 1) % 3])
            to = p + (q - p) * (h[0] / (h[0] - h[1]))
            length, n, x, over, fid = length + float(np.linalg.norm(to - x)), n + 1, to, (face[f"v{k}"], face[f"v{(k + 1) % 3}"]), face[f"o{k}"]
            if fid is None or fid == r["f0"]:  # a border, or once round
                fid = None
                break
        if fid is not None:
            done = fid == r["f1"]
            if done:
                length, n, over = length + float(np.linalg.norm(np.array([r["gx"], r["gy"], r["gz"]]) - x)), n + 1, (-2, -2)
            out.append(r | {"x": x[0], "y": x[1], "z": x[2], "length": length, "n": n, "fid": fid, "a": over[0], "b": over[1]})
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return pa.table([pa.array([r[c] for r in out], kinds[x.split()[1]]) for c, x in zip(names, _TRACE.split(", "), strict=True)], names=names)


def facet_paths(mesh: MeshFrame, queries: DataFrame, normals: DataFrame, cell: int = tree.LEAF) -> DataFrame:
    """queries: qid, mesh_id, f0, x0, y0, z0, f1, x1, y1, z1; normals: mesh_id, fid, nx, ny,
    nz, a direction for each face. mesh_id, qid, length, n (points): the shorter of two
    traces from the first point to the second; nulls where neither arrives.

    A trace is a line over the surface. In a face it keeps to the plane that has the face's
    direction and holds the point where the trace came in, so it has two ways out of its
    first face, and one out of every other. It ends at a border, at an edge of more than
    two faces, where a face has no direction, and where it comes back to its first face.

    Faces are dealt to cells of bounded size by place. A round takes all traces of all
    queries through the cells that they are in, so rounds count cells; a cell with many
    traces is taken in blocks."""
    half = half_edges(mesh.faces)
    two = half.groupBy(*EDGE).agg(F.count("*").alias("k"), F.min("fid").alias("lo"), F.max("fid").alias("hi")).where("k = 2")
    other = half.join(two, EDGE).groupBy("mesh_id", "fid").agg(*[F.max(F.when(F.col("slot") == k, F.col("lo") + F.col("hi") - F.col("fid"))).alias(f"o{k}") for k in range(3)])
    dealt = face_tree(mesh, cell).items.withColumnRenamed("leaf", "cell")
    faces = dealt.join(other, ["mesh_id", "fid"], "left").join(normals.select("mesh_id", "fid", "nx", "ny", "nz"), ["mesh_id", "fid"], "left")
    faces = stored(faces.select("mesh_id", "cell", "fid", *_FACE))
    place = faces.select("mesh_id", "fid", "cell")
    most = faces.groupBy("mesh_id").agg(F.count("*").alias("most"))
    names = [x.split()[0] for x in _TRACE.split(", ")]
    none = F.lit(None).cast("long")
    start = queries.select("mesh_id", "qid", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), F.col("f0").alias("fid"), none.alias("a"), none.alias("b"), *[F.col(f"{c}0").alias(c) for c in "xyz"], F.lit(0.0).alias("length"), F.lit(1).alias("n"), "f0", "f1", *[F.col(f"{c}1").alias(f"g{c}") for c in "xyz"])
    now = stored(start.join(most, "mesh_id").join(place, ["mesh_id", "fid"]).join(place.select("mesh_id", F.col("fid").alias("f1")), ["mesh_id", "f1"]).select(*names, "cell"))
    arrived = None
    while not now.isEmpty():
        blocks = now.groupBy("mesh_id", "cell").agg(F.ceil(F.count("*") / 4096).cast("int").alias("blocks"))
        sent = now.join(blocks, ["mesh_id", "cell"]).withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
        there = faces.join(blocks, ["mesh_id", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = sent.select(F.lit(1).alias("kind"), "block", "cell", *names).unionByName(there.select(F.lit(0).alias("kind"), "block", "cell", "mesh_id", "fid", *_FACE), allowMissingColumns=True)
        moved = stored(rows.groupBy("mesh_id", "cell", "block").applyInArrow(_trace, _TRACE))
        done = moved.where("b = -2")
        arrived = done if arrived is None else arrived.unionByName(done)
        last, now = now, stored(moved.where("b is null or b <> -2").join(place, ["mesh_id", "fid"]).select(*names, "cell"))
        discard(last)
    best = F.min(F.struct("length", "n")).alias("_b")
    found = (arrived if arrived is not None else start.withColumn("most", F.lit(0)).limit(0)).groupBy("mesh_id", "qid").agg(best)
    return queries.select("mesh_id", "qid").distinct().join(found, ["mesh_id", "qid"], "left").select("mesh_id", "qid", "_b.length", "_b.n")


def visit(mesh: MeshFrame, visitor: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, order: DataFrame | None = None) -> DataFrame:
    """Hands every triangle to a visitor, by Arrow batches of mesh_id, fid, v0, v1, v2 and
    the corners' positions x0..z2; its rows are the result. With ``order`` (mesh_id, fid,
    pos) a mesh's triangles come in that order, all in one task (a walk such as that of
    ``graph.winding`` or ``graph.distances`` over the dual); without, in any order anywhere."""
    rows = corners(mesh.vertices, mesh.faces).select("mesh_id", "fid", "v0", "v1", "v2", *[c for k in range(3) for c in Vec.of(suffix=str(k)).columns(suffix=str(k))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield visitor(batch)

    if order is not None:
        names = rows.columns
        rows = rows.join(order.select("mesh_id", "fid", "pos"), ["mesh_id", "fid"]).repartition("mesh_id").sortWithinPartitions("mesh_id", "pos", "fid").select(*names)
    return rows.mapInArrow(run, schema)
