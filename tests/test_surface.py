"""Surface paths, visits, UV upkeep, frames and loops, against plain versions."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe import fixtures as X
from meshframe.functions import vec
from meshframe.operators import edit, frames, graph, measure, spatial, surface, texture
from meshframe.plans import iterate
from meshframe.schema import MeshFrame
from meshframe.sources import meshes


@pytest.fixture(scope="module")
def hill(spark):
    """A bumpy 7 x 7 height map."""
    rows = [(i, j, math.sin(i * 1.3) + math.cos(j * 0.9) * 1.5) for i in range(7) for j in range(7)]
    return meshes.height_map(spark.createDataFrame(rows, "i int, j int, z double"), winding="consistent")


def local(mesh):
    p = {r["vid"]: np.array([r["x"], r["y"], r["z"]]) for r in mesh.vertices.collect()}
    return p, {r["fid"]: (r["v0"], r["v1"], r["v2"]) for r in mesh.faces.collect()}


def shortest(p, faces, a, b):
    near = {v: set() for v in p}
    for t in faces.values():
        for k in range(3):
            near[t[k]].add(t[(k + 1) % 3])
            near[t[(k + 1) % 3]].add(t[k])
    best, heap = {a: (0.0, [a])}, [(0.0, a)]
    while heap:
        d, v = heapq.heappop(heap)
        if v == b:
            return best[v][1]
        if d > best[v][0]:
            continue
        for w in near[v]:
            new = d + float(np.linalg.norm(p[w] - p[v]))
            if w not in best or new < best[w][0] - 1e-12:
                best[w] = (new, [*best[v][1], w])
                heapq.heappush(heap, (new, w))
    return None


def test_surface_paths(spark, hill):
    p, faces = local(hill)
    ends = [((0.3, 0.2, 1.0), (5.6, 4.7, 0.0)), ((6.0, 0.0, 3.0), (0.0, 6.0, -1.0)), ((3.1, 3.2, 0.0), (3.0, 3.1, 0.1)), ((2.4, 1.3, 2.0), (2.1, 5.8, 1.0))]
    q = spark.createDataFrame([(k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(ends)], "qid long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    got = {}
    for r in sorted(surface.surface_paths(q, hill).collect(), key=lambda r: (r["qid"], r["pos"])):
        got.setdefault(r["qid"], []).append(np.array([r["x"], r["y"], r["z"]]))
    flat = spark.createDataFrame([(2 * k + s, *map(float, e[s])) for k, e in enumerate(ends) for s in (0, 1)], "qid long, x double, y double, z double")
    spot = {r["qid"]: (r["fid"], np.array([r["x"], r["y"], r["z"]])) for r in spatial.closest_surface_point(flat, hill).collect()}
    for k, (a, b) in enumerate(ends):
        v = [min(p, key=lambda i: (round(float(((p[i] - np.array(e)) ** 2).sum()), 12), i)) for e in (a, b)]  # noqa: B023
        way = shortest(p, faces, *v)
        points = [p[i] for i in way]
        if len(way) == 1:
            points = [spot[2 * k][1], spot[2 * k + 1][1]]
        else:
            if set(way[:2]) <= set(faces[spot[2 * k][0]]):
                points[0] = spot[2 * k][1]
            if set(way[-2:]) <= set(faces[spot[2 * k + 1][0]]):
                points[-1] = spot[2 * k + 1][1]
        length = lambda w: sum(float(np.linalg.norm(y - x)) for x, y in zip(w, w[1:], strict=False))
        assert length(got[k]) == pytest.approx(length(points), abs=1e-9)
        assert np.allclose(got[k][0], points[0]) and np.allclose(got[k][-1], points[-1])


def test_facet_paths_bend_with_their_planes(spark):
    rows = [(i, j, 0.0) for i in range(6) for j in range(6)]
    mesh = meshes.height_map(spark.createDataFrame(rows, "i int, j int, z double"), winding="consistent")
    faces = {r["fid"]: (r["v0"], r["v1"], r["v2"]) for r in mesh.faces.collect()}
    f0, f1 = (min(f for f, t in faces.items() if c in t) for c in (1001, 4004))
    q = spark.createDataFrame([(0, 0, f0, 0.6, 0.7, 0.0, f1, 3.6, 3.7, 0.0), (1, 0, f0, 0.6, 0.7, 0.0, f0, 0.6, 0.7, 0.0), (2, 0, f0, 0.6, 0.7, 0.0, -5, 0.0, 0.0, 0.0)], "qid long, mesh_id long, f0 long, x0 double, y0 double, z0 double, f1 long, x1 double, y1 double, z1 double")
    straight = mesh.faces.select("mesh_id", "fid", F.lit(-1.0).alias("nx"), F.lit(1.0).alias("ny"), F.lit(0.0).alias("nz"))
    got = {r["qid"]: r["length"] for r in surface.facet_paths(mesh, q, straight).collect()}
    assert got[0] == pytest.approx(math.hypot(3.0, 3.0)) and got[1] == 0 and got[2] is None
    none = surface.facet_paths(mesh, q, straight.where("false")).collect()
    assert [r["length"] for r in sorted(none, key=lambda r: r["qid"])] == [None, 0.0, None]


def test_visits_in_order(spark, hill):
    import pyarrow as pa

    seen = surface.visit(hill, lambda b: pa.RecordBatch.from_arrays([b.column("fid")], names=["fid"]), "fid long").collect()
    assert sorted(r["fid"] for r in seen) == sorted(r["fid"] for r in hill.faces.collect())
    order = hill.faces.select("mesh_id", "fid", (-F.col("fid")).alias("pos"))
    back = surface.visit(hill, lambda b: pa.RecordBatch.from_arrays([b.column("fid")], names=["fid"]), "fid long", order).collect()
    assert [r["fid"] for r in back] == sorted((r["fid"] for r in seen), reverse=True)


def uv_mesh(mesh):
    """UVs that are a linear map of the position, on faces not divisible by 3; two materials."""
    c = meshes.corners(mesh.vertices, mesh.faces.where("fid % 3 <> 0"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), (F.col(f"x{k}") / 7).alias("u"), (F.col(f"y{k}") / 7).alias("v")) for k in range(3)]))
    flat = c.select("mesh_id", (F.col("fid") % 2).cast("long").alias("mid"), "fid", rows.alias("r")).select("mesh_id", "mid", "fid", "r.*")
    return texture.with_corner_uvs(mesh, flat)


def check_uvs(mesh):
    """Every textured corner has the UV of its position."""
    rows = texture.corner_uvs(mesh).join(mesh.vertices, ["mesh_id", "vid"]).collect()
    assert all(abs(r["u"] - r["x"] / 7) < 1e-4 and abs(r["v"] - r["y"] / 7) < 1e-4 for r in rows)
    return {(r["fid"]) for r in rows}


def test_uvs_follow_edits(spark, hill):
    m = uv_mesh(hill)
    faces = check_uvs(m)
    assert faces and all(f % 3 for f in faces)
    assert check_uvs(edit.turned(m, m.faces.where("fid % 4 = 1"))) == faces
    some = m.faces.where("fid % 5 < 2").select("mesh_id", "fid")
    points = meshes.corners(m.vertices, m.faces.join(some, ["mesh_id", "fid"])).select("mesh_id", "fid", *[(F.col(f"{a}0") * 0.5 + F.col(f"{a}1") * 0.3 + F.col(f"{a}2") * 0.2).alias(a) for a in "xyz"])
    new = check_uvs(edit.subdivided(m, points))
    assert {f // 3 for f in new} == faces and len(new) == sum(3 if f % 5 < 2 else 1 for f in faces)
    diagonal = edit.half_edges(m.faces).where("w - u = 1001").select("mesh_id", "u", "w").distinct()
    assert check_uvs(edit.flipped_mesh(m, diagonal)) == set()  # the two faces of a cell have different materials
    one = m.with_(uvs=m.uvs, face_uvs=m.face_uvs.withColumn("mid", F.lit(0).cast("long")), materials=None)
    one = texture.with_corner_uvs(one, texture.corner_uvs(m).withColumn("mid", F.lit(0).cast("long")))
    pairs = {f // 2 for f in faces if f ^ 1 in faces}
    assert {f // 2 for f in check_uvs(edit.flipped_mesh(one, diagonal))} == pairs
    assert len(check_uvs(meshes.repacked(m))) == len(faces)
    part = meshes.face_subset(m, m.faces.where("fid % 2 = 1"))
    assert check_uvs(part) == {f for f in faces if f % 2} and part.uvs.where("mid = 0").count() == 0
    assert len(check_uvs(meshes.union(m, m))) == len(faces)


def test_materials_of_the_same_id_are_replaced(spark):
    one = lambda rows: spark.createDataFrame(rows, "mesh_id long, mid long, rows int, cols int, texture binary")
    out = texture.copy_materials(one([(0, 0, 1, 1, b"a"), (0, 1, 2, 2, b"b")]), one([(0, 1, 3, 3, b"c"), (0, 7, 4, 4, b"d")]))
    assert sorted((r["mid"], r["rows"]) for r in out.collect()) == [(0, 1), (1, 3), (7, 4)]


def test_curvature_of_moved_vertices(spark, hill):
    before = measure.curvature(hill)
    up = spark.createDataFrame([(0, 3003, 3.0, 3.0, 4.0), (0, 1, 1.1, 0.0, 0.0)], "mesh_id long, vid long, x double, y double, z double")
    mesh, part = measure.moved_curvature(hill, before, up)
    want = {r["vid"]: r for r in measure.curvature(mesh).collect()}
    got = part.collect()
    assert len(got) == len(want)
    for r in got:
        for c in ("kp1", "kp2", "nx", "d1x", "d2z"):
            assert r[c] == pytest.approx(want[r["vid"]][c], abs=1e-9)
        d1, d2, n = (np.array([r[f"{k}{a}"] for a in "xyz"]) for k in ("d1", "d2", "n"))
        assert abs(d1 @ d2) < 1e-9 and abs(d1 @ n) < 1e-9 and np.linalg.norm(d1) == pytest.approx(1)


def test_givens(spark):
    for a, b in ((3.0, 4.0), (-3.0, 4.0), (4.0, -3.0), (-1.0, -7.0), (0.0, 2.0), (0.0, -2.0), (5.0, 0.0), (-5.0, 0.0), (0.0, 0.0)):
        g = spark.range(1).select(vec.givens(F.lit(a), F.lit(b)).alias("g")).first()["g"]
        assert g["r"] == pytest.approx(math.hypot(a, b)) and g["c"] * a - g["s"] * b == pytest.approx(g["r"]) and g["s"] * a + g["c"] * b == pytest.approx(0)
        assert g["c"] ** 2 + g["s"] ** 2 == pytest.approx(1)


def test_trees_and_texts():
    tree = frames.put_named({"id": 1}, "focus", (1, 2, 3))
    assert frames.named_vertex(tree, "focus") == (1, 2, 3) and frames.named_vertex(tree, "id") is None and frames.named_vertex(tree, "x") is None
    assert frames.vertex_of(frames.add_vertex([], (4, 5, 6))[0]) == (4, 5, 6)
    o = frames.Orientation()
    assert frames.Orientation.from_tree(o.to_tree()) == o and str(o) == "normal 0 0 1; up 0 1 0"
    c = frames.Camera((1.0, 2.0, 9.0), fov=40.0)
    assert frames.Camera.from_tree(c.to_tree()) == c and frames.Camera.from_tree({}) is None and "position 1 2 9" in str(c)
    assert frames.Transform().is_identity() and not frames.Transform.translation((0, 0, 1)).is_identity()


def test_empty_inputs(spark, hill):
    none = MeshFrame.empty(spark)
    q = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "qid long, x double, y double, z double, ux double, uy double, uz double")
    assert spatial.ray_cast(q, none).count() == 0 and spatial.closest_surface_point(q, none).count() == 0
    assert spatial.closest_surface_point(q.where("false"), hill).count() == 0
    assert frames.procrustes(none.vertices, hill.vertices).is_identity()


def test_twisted_components(spark):
    signs, parts = graph.winding(X.literal(spark, "square", "cube", "moebius"))
    assert {(r["mesh_id"], r["twisted"]) for r in parts.collect()} == {(1, False), (3, False), (6, True)}
    assert {r["sign"] for r in signs.where("mesh_id = 6").collect()} == {1}


def test_unfinished_loops_raise(spark):
    grow = lambda df: df.select((F.col("id") + 1).alias("id"))
    with pytest.raises(iterate.Unfinished):
        iterate.fixpoint(spark.range(3), grow, lambda df: tuple(df.agg(F.sum("id")).first()), rounds=2)
    with pytest.raises(ValueError):
        edit.split_to_area(X.literal(spark, "square"), 0)


def test_discarded_tables_are_gone(spark):
    table = iterate.stored(spark.range(10))
    assert table.count() == 10
    iterate.discard(table)
    with pytest.raises(Exception):
        table.count()
