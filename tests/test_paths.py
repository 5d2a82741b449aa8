"""Routes, traces, path doubling, eigen-solver, fits and flips against plain versions."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.functions.eigen import symmetric_eigen
from meshframe.operators import edit, frames, graph, kernels, routes, surface, texture, topology
from meshframe.sources import meshes


@pytest.fixture(scope="module")
def rough(spark):
    rng = random.Random(1)
    rows = [(i, j, rng.random() * 3) for i in range(12) for j in range(12) if not (i == 6 and 2 <= j <= 9)]
    m = meshes.height_map(spark.createDataFrame(rows, "i int, j int, z double"), winding="consistent")
    v = spark.createDataFrame([tuple(r) for r in m.vertices.select("mesh_id", "vid", "x", "y", "z").collect()] + [(0, 99999, 5.0, 5.0, 5.0)], "mesh_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([tuple(r) for r in m.faces.select("mesh_id", "fid", "v0", "v1", "v2").collect()], "mesh_id long, fid long, v0 long, v1 long, v2 long")
    return m.with_(vertices=v, faces=f)


def test_routes(spark, rough):
    at = {r["vid"]: np.array([r["x"], r["y"], r["z"]]) for r in rough.vertices.collect()}
    near = {}
    for r in graph.weighted_edges(rough, lambda a, b: (b - a).norm() + F.greatest(b.z - a.z, F.lit(0.0))).collect():
        near.setdefault(r["vid"], []).append((r["nbr"], r["w"]))

    def least(src, dst):
        heap, seen = [(0.0, src)], {}
        while heap:
            d, v = heapq.heappop(heap)
            if v not in seen:
                seen[v] = d
                for n, w in near.get(v, ()):
                    heapq.heappush(heap, (d + w, n))
        return seen.get(dst)

    ids = sorted(v for v in at if v != 99999)
    pairs = [(0, ids[0], ids[-1]), (0, ids[0], ids[1]), (0, ids[5], ids[5]), (0, ids[40], ids[90]), (0, ids[0], 99999), (0, ids[0], -7)]
    df = spark.createDataFrame(pairs, "mesh_id long, src long, dst long")
    for cell in (16, 512):
        found, seen = routes.routes(rough, df, lambda a, b: (b - a).norm() + F.greatest(b.z - a.z, F.lit(0.0)), cell=cell)
        got = {(r["src"], r["dst"]): r["d"] for r in found.collect()}
        want = {(s, t): least(s, t) for _, s, t in pairs}
        assert got == pytest.approx({k: d for k, d in want.items() if d is not None}, abs=1e-9)
    way = graph.paths(seen, df).collect()
    cost = {(v, n): w for v, x in near.items() for n, w in x}
    for s, t in got:
        steps = [r["vid"] for r in sorted((r for r in way if (r["src"], r["dst"]) == (s, t)), key=lambda r: -r["back"])]
        assert steps[0] == s and steps[-1] == t and len(set(steps)) == len(steps)
        assert sum(cost[p] for p in zip(steps, steps[1:], strict=False)) == pytest.approx(got[s, t], abs=1e-9)
    # a short way leaves most of the mesh alone
    assert seen.where(f"src = {ids[0]} and dst = {ids[1]}").count() < 40
    assert routes.routes(rough, df.where("false"))[0].count() == 0


def test_traces_cross_cells(spark):
    rows = [(i, j, 0.0) for i in range(14) for j in range(14)]
    mesh = meshes.height_map(spark.createDataFrame(rows, "i int, j int, z double"), winding="consistent")
    c = meshes.corners(mesh.vertices, mesh.faces).collect()
    inside = lambda x, y: next(r["fid"] for r in c if _within(x, y, r))
    rng = random.Random(4)
    q = []
    for k in range(12):
        a, b = (rng.uniform(0.05, 12.9), rng.uniform(0.05, 12.9)), (rng.uniform(0.05, 12.9), rng.uniform(0.05, 12.9))
        q.append((k, 0, inside(*a), *a, 0.0, inside(*b), *b, 0.0))
    df = spark.createDataFrame(q, "qid long, mesh_id long, f0 long, x0 double, y0 double, z0 double, f1 long, x1 double, y1 double, z1 double")
    for r in q[:3]:  # each face's plane holds the straight way between the two points
        n = (-(r[8] - r[4]), r[7] - r[3], 0.0)
        plane = mesh.faces.select("mesh_id", "fid", *[F.lit(float(v)).alias(f"n{a}") for v, a in zip(n, "xyz", strict=True)])
        got = surface.facet_paths(mesh, df.where(f"qid = {r[0]}"), plane, cell=20).first()
        assert got["length"] == pytest.approx(math.dist(r[3:6], r[7:10]), abs=1e-9)
    lost = surface.facet_paths(mesh, df, mesh.faces.select("mesh_id", "fid", F.lit(1.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nz")), cell=20)
    assert lost.count() == len(q)


def _within(x, y, r):
    s = [(r[f"x{(k + 1) % 3}"] - r[f"x{k}"]) * (y - r[f"y{k}"]) - (r[f"y{(k + 1) % 3}"] - r[f"y{k}"]) * (x - r[f"x{k}"]) for k in range(3)]
    return all(v >= 0 for v in s) or all(v <= 0 for v in s)


def test_eigen(spark):
    rng = np.random.default_rng(2)
    for n in (3, 4):
        cases = []
        for k in range(8):
            a = rng.normal(size=(n, n))
            cases.append((k, (a + a.T).ravel().tolist()))
        cases += [(8, np.eye(n).ravel().tolist()), (9, [0.0] * n * n), (10, np.diag([1e-9, 1.0] + [1e9] * (n - 2)).ravel().tolist())]
        df = spark.createDataFrame(cases, "k long, m array<double>")
        for r in df.select("m", F.inline(F.array(symmetric_eigen(F.col("m"), n)))).collect():
            m, v = np.array(r["m"]).reshape(n, n), np.array(r["vectors"])
            assert np.allclose(v @ v.T, np.eye(n), atol=1e-12)
            assert np.allclose(m @ v.T, v.T * np.array(r["values"]), atol=1e-12 * max(1, np.abs(m).max()))
            assert np.allclose(np.sort(r["values"]), np.linalg.eigvalsh(m), atol=1e-12 * max(1, np.abs(m).max()))
            assert np.all(np.diff(np.abs(r["values"])) <= 1e-12 * max(1, np.abs(m).max()))


def test_fits_of_many_meshes(spark):
    rng = np.random.default_rng(3)
    rows, moved, rot = [], [], {}
    for m in range(5):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        rot[m] = (q, 0.5 + m, rng.normal(size=3))
        for v in range(12):
            p = rng.normal(size=3) * (1 if m != 4 or v < 99 else 0)
            rows.append((m, v, *p.tolist()))
            moved.append((m, v, *(rot[m][1] * q @ p + rot[m][2]).tolist()))
    rows += [(7, 0, 1.0, 1.0, 1.0), (7, 1, 1.0, 1.0, 1.0), (8, 0, 3.0, 3.0, 3.0)]
    moved += [(7, 0, 2.0, 2.0, 2.0), (7, 1, 2.0, 2.0, 2.0)]
    s, t = (spark.createDataFrame(x, "mesh_id long, vid long, x double, y double, z double") for x in (rows, moved))
    fits = frames.procrustes_each(s, t)
    for r in fits.where("mesh_id < 5").collect():
        q, k, d = rot[r["mesh_id"]]
        assert np.allclose(np.array(r["rotation"]).reshape(3, 3), q, atol=1e-9) and r["size"] == pytest.approx(k) and np.allclose([r["tx"], r["ty"], r["tz"]], d, atol=1e-9)
    got = {(r["mesh_id"], r["vid"]): (r["x"], r["y"], r["z"]) for r in frames.fitted(s, fits).collect()}
    assert got[8, 0] == (3.0, 3.0, 3.0) and got[7, 0] == pytest.approx((2.0, 2.0, 2.0))
    mirror = t.withColumn("x", -F.col("x"))
    one = frames.procrustes_each(s, mirror, scale=False).where("mesh_id = 1").first()
    assert np.linalg.det(np.array(one["rotation"]).reshape(3, 3)) == pytest.approx(1) and one["size"] == 1


def test_flips_of_any_edges(spark, rough):
    every = topology.edges(rough.faces).select("mesh_id", "u", "w")
    chosen = edit.independent_edges(rough.faces, every).collect()
    of = {(r["u"], r["w"]): r["fids"] for r in topology.edge_faces(rough.faces).collect()}
    taken = [f for r in chosen for f in of[r["u"], r["w"]]]
    assert len(taken) == len(set(taken)) and len(chosen) > 20
    assert all(len(x) != 2 or set(x) & set(taken) for x in of.values())  # none can be added
    some = spark.createDataFrame([tuple(r) for r in every.orderBy("u", "w").limit(9).collect()], "mesh_id long, u long, w long")
    out = edit.flip_all(rough.faces, some)
    assert out.count() == rough.faces.count()
    assert out.select(F.sort_array(F.array("v0", "v1", "v2"))).distinct().count() == out.count()
    assert edit.independent_edges(rough.faces, some.where("false")).count() == 0


def test_uvs_follow_pieces(spark, rough):
    """UVs that are a linear map of the position stay one, whatever is cut."""
    c = meshes.corners(rough.vertices, rough.faces.where("fid % 3 <> 0"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), (F.col(f"x{k}") / 7).alias("u"), (F.col(f"y{k}") / 7).alias("v")) for k in range(3)]))
    flat = c.select("mesh_id", (F.col("fid") % 2).cast("long").alias("mid"), "fid", rows.alias("r")).select("mesh_id", "mid", "fid", "r.*")
    m = texture.with_corner_uvs(rough, flat)
    for out, least in ((edit.split_midpoints(m), 400), (edit.sliced(m, (5, 5, 1), (1, 0.3, 0.2)), 100)):
        got = texture.corner_uvs(out).join(out.vertices, ["mesh_id", "vid"]).collect()
        assert len(got) > least
        assert all(abs(r["u"] - r["x"] / 7) < 1e-3 and abs(r["v"] - r["y"] / 7) < 1e-3 for r in got)


def test_crossing_forms_agree(spark):
    from meshframe.functions.vec import crossing_time

    rng = random.Random(3)
    rows = [(rng.uniform(0, 1), rng.uniform(0.2, 2), rng.uniform(0.2, 2), rng.uniform(0.2, 1.5), rng.uniform(0.5, 2)) for _ in range(200)]
    df = spark.createDataFrame([(u, a, b, t, f) for u, a, b, t, f in rows], "u double, a double, b double, t double, f double")
    got = [r[0] for r in df.select(crossing_time(F.col("u"), F.lit(0.0), F.col("a"), F.col("b"), F.col("t"), F.col("f"))).collect()]
    for x, (u, a, b, t, f) in zip(got, rows, strict=True):
        assert x == pytest.approx(kernels.crossing(u, 0.0, a, b, math.cos(t), f))
        # a planar front that comes through the corner: place A, B, C and read its time off
        if x < min(f * b, u + f * a) - 1e-9:
            A, B = np.array([b, 0.0]), a * np.array([math.cos(t), math.sin(t)])
            g = np.linalg.solve(np.array([A, B]), np.array([-x, u - x]))
            assert np.linalg.norm(g) == pytest.approx(f)
