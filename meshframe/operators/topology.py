"""Topology as joins and aggregates over half-edges.

Half-edges are keyed by (mesh_id, u, w), so one huge mesh spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import Vec, area
from ..schema import MeshFrame
from ..sources.meshes import corner_vecs, corners, used_vertices, valid_faces

EDGE = ["mesh_id", "u", "w"]


def half_edges(faces: DataFrame) -> DataFrame:
    """mesh_id, fid, slot, a, b (in the face's order), o (the opposite corner), u < w."""
    v = [F.col(f"v{k}") for k in range(3)]
    rows = F.array(*[F.struct(F.lit(k).alias("slot"), v[k].alias("a"), v[(k + 1) % 3].alias("b"), v[(k + 2) % 3].alias("o")) for k in range(3)])
    h = faces.select("mesh_id", "fid", F.explode(rows).alias("h")).select("mesh_id", "fid", "h.*")
    return h.withColumn("u", F.least("a", "b")).withColumn("w", F.greatest("a", "b"))


def edges(faces: DataFrame) -> DataFrame:
    """mesh_id, u, w, nfaces."""
    return half_edges(faces).groupBy(*EDGE).agg(F.count("*").alias("nfaces"))


def edge_faces(faces: DataFrame) -> DataFrame:
    """The faces of each edge as a sorted array."""
    return half_edges(faces).groupBy(*EDGE).agg(F.count("*").alias("nfaces"), F.sort_array(F.collect_set("fid")).alias("fids"))


def numbered_edges(faces: DataFrame) -> DataFrame:
    """Edges with ids in order of their vertices."""
    return edges(faces).withColumn("eid", F.row_number().over(Window.partitionBy("mesh_id").orderBy("u", "w")) - 1)


def boundary_edges(faces: DataFrame) -> DataFrame:
    return edges(faces).where("nfaces = 1").select(*EDGE)


def irregular_edges(faces: DataFrame) -> DataFrame:
    """Edges without exactly two faces."""
    return edges(faces).where("nfaces <> 2")


def boundary_vertices(faces: DataFrame) -> DataFrame:
    b = boundary_edges(faces)
    return b.select("mesh_id", F.explode(F.array("u", "w")).alias("vid")).distinct()


def neighbours(faces: DataFrame) -> DataFrame:
    """mesh_id, vid, nbr: the one-ring of every vertex."""
    e = edges(faces)
    return e.select("mesh_id", F.col("u").alias("vid"), F.col("w").alias("nbr")).unionByName(e.select("mesh_id", F.col("w").alias("vid"), F.col("u").alias("nbr")))


def vertex_faces(faces: DataFrame) -> DataFrame:
    """mesh_id, vid, fid."""
    return faces.select("mesh_id", "fid", F.explode(F.array("v0", "v1", "v2")).alias("vid"))


def vertex_degrees(faces: DataFrame) -> DataFrame:
    """Neighbours and faces of each vertex, and the shortcut test for a boundary vertex."""
    n = neighbours(faces).groupBy("mesh_id", "vid").agg(F.count("*").alias("n_neighbours"), F.sum("nbr").alias("sum_neighbours"))
    f = vertex_faces(faces).groupBy("mesh_id", "vid").agg(F.count("*").alias("n_faces"))
    return n.join(f, ["mesh_id", "vid"]).withColumn("open_ring", F.col("n_neighbours") > F.col("n_faces"))


def dual_edges(faces: DataFrame, crossing=None) -> DataFrame:
    """Pairs of faces over edges with exactly two: mesh_id, u, w, f, g (f <> g), same
    (do both windings agree). ``crossing``, a boolean Column on u, w, says which edges count."""
    h = half_edges(faces).select(*EDGE, "fid", "a")
    one = h.groupBy(*EDGE).agg(F.count("*").alias("n"), F.min(F.struct("fid", "a")).alias("p"), F.max(F.struct("fid", "a")).alias("q")).where("n = 2")
    if crossing is not None:
        one = one.where(crossing)
    both = F.explode(F.array(F.struct(F.col("p.fid").alias("f"), F.col("q.fid").alias("g")), F.struct(F.col("q.fid").alias("f"), F.col("p.fid").alias("g"))))
    return one.select(*EDGE, (F.col("p.a") != F.col("q.a")).alias("same"), both.alias("d")).select(*EDGE, "same", "d.*")


def common_edges(faces: DataFrame) -> DataFrame:
    """For every two faces that share an edge, the first by the lower face's slot order."""
    h = half_edges(faces).select(*EDGE, "fid", "slot")
    a, b = h.withColumnRenamed("fid", "f"), h.select(*EDGE, F.col("fid").alias("g"))
    return a.join(b, EDGE).where("f < g").groupBy("mesh_id", "f", "g").agg(F.min_by(F.struct("u", "w"), "slot").alias("e")).select("mesh_id", "f", "g", "e.u", "e.w")


def opposite_face(faces: DataFrame) -> DataFrame:
    """mesh_id, fid, u, w, other: the face across an edge, null unless it has exactly two."""
    h = half_edges(faces).select(*EDGE, "fid")
    d = dual_edges(faces).select(*EDGE, F.col("f").alias("fid"), F.col("g").alias("other"))
    return h.join(d, [*EDGE, "fid"], "left")


def pseudo_boundary(faces: DataFrame, subset: DataFrame) -> DataFrame:
    """Edges of some faces that no other of these faces has."""
    return boundary_edges(faces.join(subset.select("mesh_id", "fid").distinct(), ["mesh_id", "fid"], "left_semi"))


def find_faces(faces: DataFrame, triples: DataFrame) -> DataFrame:
    """triples: qid, mesh_id, v0, v1, v2 in any order. The face of that vertex set, or -1."""
    key = F.array_sort(F.array("v0", "v1", "v2"))
    return triples.withColumn("_k", key).join(faces.select("mesh_id", "fid", key.alias("_k")), ["mesh_id", "_k"], "left").select("qid", "mesh_id", F.coalesce("fid", F.lit(-1)).alias("fid"))


def find_edges(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: qid, mesh_id, a, b. Faces of the edge between two vertices; 0 without one."""
    e = edges(faces)
    p = pairs.withColumn("u", F.least("a", "b")).withColumn("w", F.greatest("a", "b"))
    return p.join(e, EDGE, "left").select("qid", "mesh_id", F.coalesce("nfaces", F.lit(0)).alias("nfaces"))


def summary(mesh: MeshFrame) -> DataFrame:
    """A row per mesh: counts, Euler characteristic, area, dense ids."""
    v = mesh.vertices.groupBy("mesh_id").agg(F.count("*").alias("n_v"), (F.max("vid") + 1 == F.count("*")).alias("dense_vids"))
    f = corners(mesh.vertices, mesh.faces).withColumn("_a", area(*corner_vecs()))
    n = Vec.of(suffix="1") - Vec.of(suffix="0")
    f = f.withColumn("_up", (n.cross(Vec.of(suffix="2") - Vec.of(suffix="1")).z > 0).cast("bigint"))
    f = f.groupBy("mesh_id").agg(F.count("*").alias("n_f"), F.sum("_a").alias("area"), F.sum("_up").alias("n_up"))
    e = edges(mesh.faces).groupBy("mesh_id").agg(F.count("*").alias("n_e"), F.count_if(F.col("nfaces") == 1).alias("n_boundary"), F.count_if(F.col("nfaces") > 2).alias("n_irregular"))
    return v.join(f, "mesh_id", "left").join(e, "mesh_id", "left").withColumn("euler", F.col("n_v") - F.col("n_e") + F.col("n_f"))


def remove_faces(mesh: MeshFrame, ids: DataFrame, orphans: bool = False) -> MeshFrame:
    """Without some faces (and their UVs); vertices stay unless ``orphans`` go."""
    gone = ids.select("mesh_id", "fid").distinct()
    f = mesh.faces.join(gone, ["mesh_id", "fid"], "left_anti")
    from .texture import used_uvs

    return used_uvs(mesh.with_(faces=f, vertices=used_vertices(mesh.vertices, f) if orphans else mesh.vertices))


def remove_edges(mesh: MeshFrame, pairs: DataFrame) -> MeshFrame:
    """Without some edges (mesh_id, u, w) and all faces that have them."""
    gone = half_edges(mesh.faces).join(pairs.select(*EDGE).distinct(), EDGE, "left_semi")
    return remove_faces(mesh, gone)


def remove_vertices(mesh: MeshFrame, ids: DataFrame) -> MeshFrame:
    """Without some vertices, of those that no face has."""
    free = ids.select("mesh_id", "vid").join(vertex_faces(mesh.faces).select("mesh_id", "vid").distinct(), ["mesh_id", "vid"], "left_anti")
    return mesh.with_(vertices=mesh.vertices.join(free, ["mesh_id", "vid"], "left_anti"))


def remove_disconnected(mesh: MeshFrame) -> MeshFrame:
    return mesh.with_(vertices=used_vertices(mesh.vertices, mesh.faces))


def add_edges(mesh: MeshFrame, pairs: DataFrame) -> MeshFrame:
    """Connects pairs (mesh_id, a, b) and closes a face with every common neighbour."""
    n = neighbours(mesh.faces)
    p = pairs.select("mesh_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    s = p.join(n.select("mesh_id", F.col("vid").alias("a"), F.col("nbr").alias("s")), ["mesh_id", "a"]).join(n.select("mesh_id", F.col("vid").alias("b"), F.col("nbr").alias("s")), ["mesh_id", "b", "s"])
    last = mesh.faces.groupBy("mesh_id").agg(F.max("fid").alias("last"))
    new = s.join(last, "mesh_id").withColumn("fid", F.col("last") + F.row_number().over(Window.partitionBy("mesh_id").orderBy("a", "b", "s")))
    new = new.select("mesh_id", "fid", F.col("s").alias("v0"), F.col("a").alias("v1"), F.col("b").alias("v2"))
    return mesh.with_(faces=valid_faces(mesh.vertices, mesh.faces.select("mesh_id", "fid", "v0", "v1", "v2").unionByName(new)))


def triangles_of(relation: DataFrame) -> DataFrame:
    """relation: x, y. Triples with x-y, y-z and x-z in it (x < y < z)."""
    e = relation.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x < y").distinct()
    return e.join(e.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").join(e.select("x", F.col("y").alias("z")), ["x", "z"]).select("x", "y", "z")


def adjacent(f: DataFrame) -> DataFrame:
    """Predicates on two triples a, b (arrays): do they share exactly two vertices, are
    they the same set."""
    shared = F.size(F.array_intersect("a", "b"))
    return f.withColumn("adjacent", shared == 2).withColumn("same", shared == 3)


def opposite_vertices(faces: DataFrame) -> DataFrame:
    """mesh_id, fid, vid, n1, n2: the other two corners in the face's order."""
    return half_edges(faces).select("mesh_id", "fid", F.col("o").alias("vid"), F.col("a").alias("n1"), F.col("b").alias("n2"))
