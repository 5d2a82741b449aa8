"""Measures: normals, areas, angles, bounds, principal axes, curvature."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.eigen import symmetric_eigen
from ..functions.vec import Vec, affine, angle, face_vector, field, givens
from ..plans.iterate import fixpoint, stored
from ..schema import MeshFrame
from ..sources.meshes import corner_vecs, corners
from .topology import EDGE, half_edges, neighbours


def face_geometry(mesh: MeshFrame) -> DataFrame:
    """mesh_id, fid, v0..v2, n (face vector), unit (normal), area."""
    n = face_vector(*corner_vecs())
    return corners(mesh.vertices, mesh.faces).select("mesh_id", "fid", "v0", "v1", "v2", n.struct().alias("n"), n.unit().struct().alias("unit"), (n.norm() / 2).alias("area"))


def vertex_normals(mesh: MeshFrame) -> DataFrame:
    """Unit sum of the vectors of a vertex's faces; zero without faces."""
    return _normals(mesh, face_geometry(mesh))


def _normals(mesh: MeshFrame, geometry: DataFrame) -> DataFrame:
    g = geometry.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"), "n")
    s = g.groupBy("mesh_id", "vid").agg(*[F.sum(f"n.{a}").alias(f"s{a}") for a in "xyz"])
    n = Vec(*(F.coalesce(f"s{a}", F.lit(0.0)) for a in "xyz")).unit()
    return mesh.vertices.join(s, ["mesh_id", "vid"], "left").select("mesh_id", "vid", "x", "y", "z", *[c.alias(f"n{a}") for c, a in zip(n, "xyz", strict=True)])


def inner_angles(mesh: MeshFrame) -> DataFrame:
    """mesh_id, fid, vid, angle: a row per corner."""
    p = corner_vecs()
    rows = [F.struct(F.col(f"v{k}").alias("vid"), angle(p[(k + 1) % 3] - p[k], p[(k + 2) % 3] - p[k]).alias("angle")) for k in range(3)]
    return corners(mesh.vertices, mesh.faces).select("mesh_id", "fid", F.explode(F.array(*rows)).alias("r")).select("mesh_id", "fid", "r.*")


def bounds(vertices: DataFrame, inverse: Sequence[float] | None = None, by: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """Box of each group of vertices, in the frame of a matrix whose inverse is given."""
    v = affine(inverse, Vec.of()) if inverse is not None else Vec.of()
    return vertices.groupBy(*by).agg(*[f(c).alias(f"{n}_{a}") for c, a in zip(v, "xyz", strict=True) for f, n in ((F.min, "min"), (F.max, "max"))])


def box_metrics(boxes: DataFrame) -> DataFrame:
    """Centre, side lengths, diagonal, and width, height, depth of boxes."""
    lens = {f"len_{a}": F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"}
    out = boxes.withColumns({f"mid_{a}": (F.col(f"max_{a}") + F.col(f"min_{a}")) / 2 for a in "xyz"}).withColumns(lens)
    return out.withColumn("diagonal", F.sqrt(sum(F.col(c) * F.col(c) for c in lens)))


def box_union(boxes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return boxes.groupBy(*by).agg(*[f(f"{n}_{a}").alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])


def framed_boxes(boxes: DataFrame, matrix: Sequence[float]) -> DataFrame:
    """Boxes that stand in the frame of a matrix: lo_* and hi_* are where their least and
    greatest corner are outside, ext_min_* and ext_max_* the straight box about all eight."""
    at = lambda *s: affine(matrix, Vec(*(F.col(f"{n}_{a}") for n, a in zip(s, "xyz", strict=True))))
    eight = [at(i, j, k) for i in ("min", "max") for j in ("min", "max") for k in ("min", "max")]
    out = {f"{n}_{a}": c for n, v in (("lo", eight[0]), ("hi", eight[7])) for a, c in zip("xyz", v, strict=True)}
    for axis, a in enumerate("xyz"):
        out[f"ext_min_{a}"], out[f"ext_max_{a}"] = (f(*[tuple(v)[axis] for v in eight]) for f in (F.least, F.greatest))
    return boxes.withColumns(out)


def fixed_boxes(boxes: DataFrame, matrix: Sequence[float]) -> DataFrame:
    """The same boxes with their two corners, as they are outside, for good."""
    f = framed_boxes(boxes, matrix)
    return f.select(*[F.col(f"{'lo' if c.startswith('min_') else 'hi'}_{c[-1]}").alias(c) if c[:4] in ("min_", "max_") and c[4:] in ("x", "y", "z") else F.col(c) for c in boxes.columns])


def boxes_overlap(a: str, b: str) -> Column:
    """Do the closed boxes of two aliases meet?"""
    tests = [(F.col(f"{a}.min_{c}") <= F.col(f"{b}.max_{c}")) & (F.col(f"{b}.min_{c}") <= F.col(f"{a}.max_{c}")) for c in "xyz"]
    return tests[0] & tests[1] & tests[2]


def covariance(vertices: DataFrame, by: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """Population covariance of positions (six values a group)."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return vertices.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m_{a}") for a in "xyz"], *[F.covar_pop(a, b).alias(f"c_{a}{b}") for a, b in pairs])


def principal_axes(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by size and their vectors (columns), from a covariance row."""
    c = np.array([[row["c_" + "".join(sorted((a, b)))] for b in "xyz"] for a in "xyz"])
    w, v = np.linalg.eigh(c)
    order = np.argsort(-np.abs(w), kind="stable")
    return w[order], v[:, order]


def axes(vertices: DataFrame, by: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """Principal axes of each group of vertices: n, centre m_x .. m_z, values (variances along
    the axes, the largest first) and vectors (an array each), all as Columns."""
    entries = F.array(*[F.col("c_" + "".join(sorted((a, b)))) for a in "xyz" for b in "xyz"])
    c = covariance(vertices, by)
    return c.select(*by, "n", *[f"m_{a}" for a in "xyz"], F.inline(F.array(symmetric_eigen(entries, 3))))


def axes_to_rotation(vectors: np.ndarray) -> np.ndarray:
    """Each axis goes to the coordinate it is nearest to, with a positive sign there."""
    out, free = np.zeros((3, 3)), [0, 1, 2]
    for k in range(3):
        v = vectors[:, k]
        at = max(free, key=lambda i: (abs(v[i]), -i))
        free.remove(at)
        out[:, at] = v if v[at] >= 0 else -v
    return out


def curvature(mesh: MeshFrame) -> DataFrame:
    """Principal curvatures of each vertex from the tensor sum of w k T T' over its ring,
    read off the diagonal in the tangent frame, and the frame's axes turned by the rotation
    that takes that diagonal to its first axis: mesh_id, vid, nx, ny, nz, kp1, kp2, d1x, d1y,
    d1z, d2x, d2y, d2z."""
    g = stored(face_geometry(mesh).select("mesh_id", "fid", "v0", "v1", "v2", "n", "area"))
    h = half_edges(mesh.faces).select(*EDGE, "fid").join(g.select("mesh_id", "fid", "area"), ["mesh_id", "fid"])
    s_edge = h.groupBy(*EDGE).agg(F.sum("area").alias("s_e"))
    s_vtx = g.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"), "area").groupBy("mesh_id", "vid").agg(F.sum("area").alias("s_v"))
    v = stored(_normals(mesh, g).join(s_vtx, ["mesh_id", "vid"]))
    ends = s_edge.select("mesh_id", F.explode(F.array(F.struct(F.col("u").alias("vid"), F.col("w").alias("nbr")), F.struct(F.col("w").alias("vid"), F.col("u").alias("nbr")))).alias("d"), "s_e").select("mesh_id", "d.*", "s_e")
    r = ends.join(v, ["mesh_id", "vid"]).join(mesh.vertices.select("mesh_id", F.col("vid").alias("nbr"), *Vec.of().columns("p")), ["mesh_id", "nbr"])
    n, u = Vec.of("n"), (Vec.of("p") - Vec.of()).unit()
    t = (n * u.dot(n) - u).unit()
    wk = F.col("s_e") / F.col("s_v") * 2 * n.dot(u)
    terms = {"xx": t.x * t.x, "xy": t.x * t.y, "xz": t.x * t.z, "yy": t.y * t.y, "yz": t.y * t.z, "zz": t.z * t.z}
    m = r.groupBy("mesh_id", "vid").agg(*[F.sum(wk * c).alias(k) for k, c in terms.items()])
    m = m.join(v.select("mesh_id", "vid", "nx", "ny", "nz"), ["mesh_id", "vid"])
    # a Householder reflection takes the first axis to the normal; the others span the tangent plane
    e, n = Vec(1.0, 0.0, 0.0), Vec.of("n")
    less = (e - n).norm2() > (e + n).norm2()
    w = Vec(*(F.when(less, a).otherwise(b) for a, b in zip(e - n, e + n, strict=True))).unit()
    m = m.select("*", *w.columns("w"))
    w = Vec.of("w")
    q2 = Vec(w.x * w.y * -2, 1 - 2 * w.y * w.y, w.z * w.y * -2)
    q3 = Vec(w.x * w.z * -2, w.y * w.z * -2, 1 - 2 * w.z * w.z)

    def form(q: Vec) -> Column:
        c = F.col
        return c("xx") * q.x * q.x + c("yy") * q.y * q.y + c("zz") * q.z * q.z + 2 * (c("xy") * q.x * q.y + c("xz") * q.x * q.z + c("yz") * q.y * q.z)

    m = m.select("*", form(q2).alias("fa"), form(q3).alias("fb"))
    a, b = F.col("fa"), F.col("fb")
    m = m.select("*", givens(a, b).alias("g"))
    c, s = F.col("g.c"), F.col("g.s")
    first, second = q2 * c - q3 * s, q2 * s + q3 * c
    return m.select("mesh_id", "vid", "nx", "ny", "nz", (3 * a - b).alias("kp1"), (3 * b - a).alias("kp2"), *first.columns("d1"), *second.columns("d2"))


def moved_curvature(mesh: MeshFrame, curved: DataFrame, updates: DataFrame) -> tuple[MeshFrame, DataFrame]:
    """updates: mesh_id, vid, x, y, z. The mesh with some vertices moved, and its
    ``curvature``, worked out again for these vertices and their rings only."""
    from .edit import move

    out = mesh.with_(vertices=move(mesh.vertices, updates))
    here = updates.select("mesh_id", "vid").distinct()
    ring = neighbours(mesh.faces).join(here, ["mesh_id", "vid"], "left_semi").select("mesh_id", F.col("nbr").alias("vid"))
    touched = stored(here.unionByName(ring).distinct())
    flat = mesh.faces.select("mesh_id", "fid", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    near = flat.join(touched, ["mesh_id", "vid"], "left_semi").select("mesh_id", "fid").distinct()
    part = out.with_(faces=mesh.faces.join(near, ["mesh_id", "fid"], "left_semi"))
    new = curvature(part).join(touched, ["mesh_id", "vid"], "left_semi")
    return out, curved.join(touched, ["mesh_id", "vid"], "left_anti").select(*new.columns).unionByName(new)


def curvature_metrics(mesh: MeshFrame, curved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per face the means of its corners' curvatures and the determinant of their normals;
    per vertex the mean determinant of its faces. curved: a result of ``curvature``."""
    f = mesh.faces.select("mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("slot", "vid"))
    c = f.join(curved, ["mesh_id", "vid"])
    pick = lambda k: F.max(F.when(F.col("slot") == k, F.struct(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z")))).alias(f"n{k}")
    face = c.groupBy("mesh_id", "fid").agg(F.avg("kp1").alias("kp1"), F.avg("kp2").alias("kp2"), *[pick(k) for k in range(3)])
    det = field(F.col("n2")).dot(field(F.col("n0")).cross(field(F.col("n1"))))
    face = face.select("mesh_id", "fid", "kp1", "kp2", det.alias("det"))
    vertex = f.join(face.select("mesh_id", "fid", "det"), ["mesh_id", "fid"]).groupBy("mesh_id", "vid").agg(F.avg("det").alias("det"))
    return face, vertex


def front(mesh: MeshFrame) -> DataFrame:
    """The faces of a mesh's front: from all faces, those stay whose normals are near the
    mean (within twice the standard deviation) and whose centres lie before the mean
    position, until none go. Returns mesh_id, fid, unit, centre."""
    return fixpoint(front_state(mesh), front_round, lambda d: tuple(d.agg(F.count("*"), F.sum("fid")).first()))


def front_state(mesh: MeshFrame) -> DataFrame:
    """What a round needs of each face."""
    a, b, c = corner_vecs()
    centre = (a + b + c) * (1 / 3)
    return corners(mesh.vertices, mesh.faces).select("mesh_id", "fid", face_vector(a, b, c).unit().struct().alias("unit"), centre.struct().alias("centre"))


def front_round(state: DataFrame) -> DataFrame:
    """One round of ``front``; a mesh with one face left stays as it is."""
    mean = state.groupBy("mesh_id").agg(F.count("*").alias("n"), *[F.avg(f"unit.{a}").alias(f"n{a}") for a in "xyz"], *[F.avg(f"centre.{a}").alias(f"c{a}") for a in "xyz"])
    joined = state.join(mean, "mesh_id")
    off = (Vec.of("n") - field(F.col("unit"))).norm2()
    spread = joined.groupBy("mesh_id").agg(F.avg(off).alias("var"))
    joined = joined.join(spread, "mesh_id")
    ahead = (field(F.col("centre")) - Vec.of("c")).dot(Vec.of("n")) > 0
    return joined.where((F.col("n") <= 1) | ((off <= 4 * F.col("var")) & ahead)).select("mesh_id", "fid", "unit", "centre")


def smooth_round(mesh: MeshFrame, most: float) -> DataFrame:
    """One Jacobi round: vertices whose mean absolute curvature exceeds ``most`` move to
    the mean of their ring. Returns all vertices, and whether each moved."""
    high = stored(curvature(mesh)).where((F.abs("kp1") + F.abs("kp2")) / 2 > most).select("mesh_id", "vid")
    ring = neighbours(mesh.faces).join(mesh.vertices.select("mesh_id", F.col("vid").alias("nbr"), "x", "y", "z"), ["mesh_id", "nbr"])
    mean = ring.join(high, ["mesh_id", "vid"], "left_semi").groupBy("mesh_id", "vid").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    out = mesh.vertices.join(mean, ["mesh_id", "vid"], "left")
    return out.select("mesh_id", "vid", *[F.coalesce(f"m{a}", a).alias(a) for a in "xyz"], F.col("mx").isNotNull().alias("moved"))


def smoothed(mesh: MeshFrame, most: float, rounds: int = 10) -> MeshFrame:
    """Rounds until no curvature exceeds ``most``, ``rounds`` at the most."""
    for _ in range(rounds):
        v = stored(smooth_round(mesh, most))
        if not v.where("moved").take(1):
            break
        mesh = mesh.with_(vertices=v.drop("moved"))
    return mesh
