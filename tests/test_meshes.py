"""Invariants on small meshes with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe import fixtures as X
from meshframe import registry
from meshframe.functions import vec
from meshframe.functions.vec import Vec
from meshframe.operators import bending, edit, frames, graph, kernels, measure, spatial, texture, topology
from meshframe.schema import MeshFrame
from meshframe.sources import meshes


def test_counts(spark):
    rows = {r["mesh_id"]: r for r in topology.summary(X.literal(spark, *X.LITERAL)).collect()}
    want = {"triangle": (3, 1, 3, 3, 0), "square": (4, 2, 5, 4, 0), "tetrahedron": (4, 4, 6, 0, 0), "cube": (8, 12, 18, 0, 0), "book": (5, 3, 7, 6, 1), "bowtie": (5, 2, 6, 6, 0), "moebius": (5, 5, 10, 5, 0), "ring": (8, 8, 16, 8, 0)}
    for k, name in enumerate(X.LITERAL):
        r = rows[k]
        assert (r["n_v"], r["n_f"], r["n_e"], r["n_boundary"], r["n_irregular"]) == want[name], name
    assert rows[list(X.LITERAL).index("cube")]["area"] == pytest.approx(6)


def test_closed_face_vectors_cancel(spark):
    g = measure.face_geometry(X.literal(spark, "cube"))
    s = g.agg(*[F.sum(f"n.{a}") for a in "xyz"]).first()
    assert max(abs(x) for x in s) < 1e-12


def test_cloud_drops_nan_and_merges(spark):
    rows = [(0, 0, 0.0, 0.0, 0.0), (0, 1, 0.00001, 0.0, 0.0), (0, 2, float("nan"), 0.0, 0.0), (0, 3, None, 0.0, 0.0), (0, 4, -1.23452, 0.0, 0.0), (0, 5, -1.2345, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "mesh_id bigint, ord bigint, x double, y double, z double")
    out = meshes.cloud(p).orderBy("vid").collect()
    assert [(r["vid"], r["x"]) for r in out] == [(0, 0.0), (1, -1.23452)]


def test_invalid_faces_go(spark):
    m = X.literal(spark, "square")
    f = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 2, 0, 1), (1, 2, 0, 0, 1), (1, 3, 0, 1, 9)], "mesh_id bigint, fid bigint, v0 bigint, v1 bigint, v2 bigint")
    assert [r["fid"] for r in meshes.set_faces(m.vertices, f).faces.collect()] == [0]


def test_empty_mesh(spark):
    m = MeshFrame.empty(spark)
    assert topology.edges(m.faces).count() == 0
    assert topology.summary(m).count() == 0


def test_slices_add_up(spark):
    m = X.literal(spark, "cube")
    size = lambda n: edit.slice_soup(m, (0.3, 0.4, 0.5), n).agg(F.sum(vec.area(*meshes.corner_vecs()))).first()[0]
    assert size((1, 2, 3)) + size((-1, -2, -3)) == pytest.approx(6)


def test_reflection_twice_is_identity(spark):
    m = X.literal(spark, "cube")
    twice = edit.reflected(edit.reflected(m, (0.2, 0, 0), (1, 1, 0)), (0.2, 0, 0), (1, 1, 0))
    a, b = ({r["vid"]: (r["x"], r["y"], r["z"]) for r in t.vertices.collect()} for t in (m, twice))
    assert all(np.allclose(a[k], b[k]) for k in a)
    assert sorted(map(tuple, m.faces.collect())) == sorted(map(tuple, twice.faces.collect()))


def test_loops_of_the_ring_and_filling(spark):
    m = X.literal(spark, "ring")
    loops = graph.boundary_loops(m).orderBy("loop").collect()
    assert [(r["loop"], r["n"], r["simple"]) for r in loops] == [(0, 4, True), (4, 4, True)]
    ordered = graph.ordered_loops(m)
    assert [r["pos"] for r in ordered.where("loop = 4").orderBy("pos").collect()] == [0, 1, 2, 3]
    new = kernels.fill_holes(m, ordered.where("loop = 4"))
    assert new.count() == 2
    faces = m.faces.unionByName(new.select("mesh_id", (F.col("k") + 100).cast("bigint").alias("fid"), "v0", "v1", "v2"))
    assert topology.boundary_edges(faces).count() == 4
    assert topology.dual_edges(faces).where("not same").count() == 0
    assert kernels.split_loops(m).groupBy("loop").count().count() == 2


def test_twist(spark):
    _, t = graph.winding(X.literal(spark, "moebius", "cube"))
    assert {r["mesh_id"]: r["twisted"] for r in t.collect()} == {6: True, 3: False}


def test_book_keeps_two_faces_together(spark):
    m = graph.manifolds(X.literal(spark, "book"))
    assert sorted(r["count"] for r in m.groupBy("manifold").count().collect()) == [1, 2]
    assert topology.irregular_edges(edit.split_irregular(X.literal(spark, "book")).faces).where("nfaces > 2").count() == 0


def test_march_on_a_flat_grid(spark):
    cells = spark.range(15 * 15).select((F.col("id") / 15).cast("int").alias("i"), (F.col("id") % 15).cast("int").alias("j"), F.lit(0.0).alias("z"))
    m = meshes.height_map(cells, winding="consistent")
    t = kernels.fast_march(m, m.vertices.where("vid = 0").select("mesh_id", F.col("vid").alias("src"))).toPandas()
    far = np.hypot(t["vid"] % 1000, t["vid"] // 1000)
    assert (np.abs(t["t"] - far) <= 0.08 * far + 1e-9).all()
    d = graph.distances(graph.weighted_edges(m), m.vertices.where("vid = 0").select("mesh_id", F.col("vid").alias("src"))).toPandas().set_index("vid")["d"]
    assert (t.set_index("vid")["t"] <= d + 1e-9).all()


def test_tetrahedra_come_and_go(spark):
    m = X.literal(spark, "cube")
    out = edit.without_tetrahedra(edit.subdivided(m))
    key = lambda f: {frozenset((r["v0"], r["v1"], r["v2"])) for r in f.collect()}
    assert key(out.faces) == key(m.faces)


def test_split_to_area(spark):
    m = edit.split_to_area(X.literal(spark, "triangle"), 0.1)
    r = measure.face_geometry(m).agg(F.max("area"), F.sum("area")).first()
    assert r[0] <= 0.1 and r[1] == pytest.approx(0.5)


def test_procrustes_recovers_a_similarity(spark):
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(0, k, *map(float, v)) for k, v in enumerate(rng.normal(size=(20, 3)))], "mesh_id bigint, vid bigint, x double, y double, z double")
    t = frames.Transform.angle_axis(0.7, (1, 2, 3), (4, 5, 6))
    t = frames.Transform(t.matrix @ np.diag([2, 2, 2, 1.0]))
    assert np.allclose(frames.procrustes(p, t.apply(p)).matrix, t.matrix)


def test_bending_energy():
    p = np.random.default_rng(1).normal(size=(12, 3))
    assert abs(kernels.bending_energy(p, p @ np.diag([1, 2, 3]) + 1)) < 1e-8
    assert kernels.bending_energy(p, p[:-1]) == -1


def test_camera():
    c = frames.Camera((0, 0, 10), (0, 0, 0), (0, 1, 0), 30)
    assert np.allclose(c.unproject(0.5, 0.5, 10), (0, 0, 0))
    assert c.orbit(90).distance() == pytest.approx(10)
    assert np.allclose(c.orbit(90).pos, (10, 0, 0), atol=1e-9)
    assert c.with_view_radius(5).fov == pytest.approx(60)
    with pytest.raises(ValueError):
        frames.Camera((0, 1, 0), (0, 0, 0), (0, 1, 0))


def test_orientation_round_trip():
    o = frames.Orientation((1.0, 0.0, 0.0), (0.0, 0.0, 1.0))
    assert frames.Orientation.from_tree(o.to_tree()) == o
    assert frames.Orientation.from_tree({"up": {"x": 1}}) is None
    assert np.allclose(frames.Orientation.of(o.matrix()).normal, o.normal)


def test_scalar_functions(spark):
    one = spark.range(1)
    t = vec.crossing_time(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(math.pi / 2), F.lit(1.0))
    g = vec.givens(F.lit(3.0), F.lit(4.0))
    x = vec.line_intersection(Vec(0, 0, 0), Vec(1, 0, 0), Vec(0.5, -1, 0), Vec(0.5, 1, 0))
    h = vec.line_plane(Vec(0, 0, 1), Vec(0, 0, 1), Vec(0, 0, 0), Vec(0, 0, 4))
    r = one.select(t.alias("t"), g.alias("g"), x.struct().alias("x"), h.struct().alias("h"), vec.meeting_parameter(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(2.0)).alias("m"), vec.quantise(F.lit(-1.23456)).alias("q")).first()
    assert r["t"] == pytest.approx(math.sqrt(0.5))
    assert (r["g"]["c"], r["g"]["s"], r["g"]["r"]) == pytest.approx((0.6, -0.8, 5.0))
    assert (r["x"]["x"], r["x"]["y"]) == (0.5, 0.0)
    assert r["h"]["z"] == 1.0 and r["m"] == 0.5 and r["q"] == pytest.approx(-1.2345)


def test_sql_functions(spark):
    vec.register_sql(spark)
    assert spark.sql("select tri_area(named_struct('x',0D,'y',0D,'z',0D), named_struct('x',1D,'y',0D,'z',0D), named_struct('x',0D,'y',1D,'z',0D))").first()[0] == 0.5


def test_images():
    i = np.arange(12, dtype=float).reshape(3, 4)
    assert texture.shrink(i, 2).shape == (2, 2)
    assert texture.shrink(i, 2).mean() == pytest.approx(i.mean())
    both, starts = texture.side_by_side([i, np.ones((6, 2))])
    assert both.shape == (6, 10) and starts == [0, 8]
    assert texture.side_by_side([i, i.astype(int)]) == (None, [])


def test_merged_materials(spark):
    m = X.literal(spark, "square").with_(
        materials=spark.createDataFrame([(1, 0, 2, 4, None), (1, 1, 2, 6, None)], "mesh_id bigint, mid bigint, rows int, cols int, texture binary"),
        uvs=spark.createDataFrame([(1, 0, 0, 0.5, 0.1), (1, 1, 0, 0.5, 0.2)], "mesh_id bigint, mid bigint, uvid bigint, u double, v double"),
        face_uvs=spark.createDataFrame([(1, 0, 0, 0, 0, 0), (1, 1, 1, 0, 0, 0)], "mesh_id bigint, mid bigint, fid bigint, uv0 bigint, uv1 bigint, uv2 bigint"),
    )
    out = texture.merged_materials(m)
    assert [(r["uvid"], round(r["u"], 6)) for r in out.uvs.orderBy("uvid").collect()] == [(0, 0.2), (1, 0.7)]
    assert {r["fid"]: r["uv0"] for r in out.face_uvs.collect()} == {0: 0, 1: 1}


def test_files(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1 2/2 3/3\n")
    m = meshes.read_obj(spark, str(tmp_path / "a.obj"))
    meshes.write_mesh(m, str(tmp_path / "m"))
    assert topology.summary(meshes.read_mesh(spark, str(tmp_path / "m"))).first()["area"] == 0.5


def test_nearest_far_away(spark):
    p = spark.createDataFrame([(k, float(k), 0.0, 0.0) for k in range(20)], "vid bigint, x double, y double, z double")
    q = spark.createDataFrame([(0, 1000.0, 0.0, 0.0), (1, 3.2, 0.0, 0.0)], "qid bigint, x double, y double, z double")
    got = {(r["qid"], r["k"]): r["vid"] for r in spatial.nearest(q, p, 2).collect()}
    assert got == {(0, 1): 19, (0, 2): 18, (1, 1): 3, (1, 2): 4}


def test_stream(spark, tmp_path):
    from meshframe.streaming import ingest

    rows = spark.sql("select timestamp'2024-01-01 00:00:00' ts, 0L mesh_id, 0.5D x, 0D y, 0D z union all select timestamp'2024-01-01 00:01:00', 0L, 0.500001D, 0D, 0D union all select timestamp'2024-01-01 00:02:00', 0L, 0.7D, 0D, 0D")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest.new_vertices(s).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("fresh").count() == 2


SF = "/root/testdata/sf0.001"


def _probed(spark):
    """All probes, grid vertices and grid faces, by id."""
    m = X.grid(spark, SF)
    at = lambda rows: {r[0]: np.array(r[1:]) for r in rows.collect()}
    e = X.points(spark, SF).select("vid", F.col("x") * 40 + 25, F.col("y") * 8 + 5, F.col("z") * 20 + 50)
    return at(e), at(m.vertices.select("vid", "x", "y", "z")), at(m.faces.select("fid", "v0", "v1", "v2"))


def _to_segment(q, a, b):
    t = min(1.0, max(0.0, float((q - a) @ (b - a) / ((b - a) @ (b - a)))))
    return float(((a + t * (b - a) - q) ** 2).sum())


def _to_face(q, a, b, c):
    n = np.cross(b - a, c - a)
    if all(np.cross(t - s, q - s) @ n >= 0 for s, t in ((a, b), (b, c), (c, a))):
        return float(((q - a) @ n) ** 2 / (n @ n))
    return min(_to_segment(q, a, b), _to_segment(q, b, c), _to_segment(q, c, a))


def test_nearest_vertex_of_every_probe(spark):
    q, _, _ = _probed(spark)
    want = {}
    for i, p in q.items():
        for k, (d2, j) in enumerate(sorted((float(((x - p) ** 2).sum()), j) for j, x in q.items())[:2]):
            want[i, k + 1] = (j * 100, d2)
    got = {(r["qid"], r["k"]): (r["vid"], r["d2"]) for r in registry.queries()["nearest_vertex_all"](spark, SF).collect()}
    assert len(q) > 40 and set(got) == set(want)
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_surface_under_every_probe(spark):
    q, v, f = _probed(spark)
    tri = [tuple(v[i] for i in t) for t in f.values()]
    got = {r["qid"]: r["d2"] for r in registry.queries()["closest_surface_point_all"](spark, SF).collect()}
    want = {i: min(_to_face(p, *t) for t in tri) for i, p in q.items()}
    assert len(q) > 40 and set(got) == set(q) and all(abs(got[i] - want[i]) < 2e-6 for i in q)
    want = {}
    for i, p in q.items():
        for a, b, c in tri:
            s = [(t[0] - u[0]) * (p[1] - u[1]) - (t[1] - u[1]) * (p[0] - u[0]) for u, t in ((a, b), (b, c), (c, a))]
            n = np.cross(b - a, c - a)
            if n[2] and (min(s) >= 0 or max(s) <= 0):
                want[i] = min(want.get(i, math.inf), a[2] + ((a[0] - p[0]) * n[0] + (a[1] - p[1]) * n[1]) / n[2])
    got = {r["qid"]: r["z"] for r in registry.queries()["ray_cast_all"](spark, SF).collect()}
    assert any(i >= 40 for i in want) and set(got) == set(want) and all(abs(got[i] - want[i]) < 2e-6 for i in want)


def test_aligned_face_of_every_probe(spark):
    q, v, f = _probed(spark)
    unit = lambda a: a / np.linalg.norm(a)
    got = {r["qid"]: r["fid"] for r in registry.queries()["aligned_faces"](spark, SF).collect()}
    assert len(q) > 40 and set(got) == set(q)
    for i, p in q.items():
        at = 5025 if i % 2 == 0 else 3010
        score = {k: float(unit(sum(v[j] for j in t) / 3 - v[at]) @ unit(p - v[at])) for k, t in f.items() if at in t}
        assert abs(score[got[i]] - max(score.values())) < 1e-9


def test_neighbours_and_faces_of_every_id(spark):
    p = {r["vid"]: np.array([r["x"], r["y"], r["z"]]) for r in X.points(spark, SF).collect()}
    got = {(r["qid"], r["k"]): r["d2"] for r in registry.queries()["knn_vertices_all"](spark, SF).collect()}
    assert set(got) == {(i, k) for i in p for k in range(1, 6)}
    for i, q in p.items():
        want = sorted(float(((x - q) ** 2).sum()) for x in p.values())[:5]
        assert np.allclose([got[i, k] for k in range(1, 6)], want, atol=2e-6)
    _, v, f = _probed(spark)
    at = {frozenset(map(int, t)): k for k, t in f.items()}
    got = {r["qid"]: r["fid"] for r in registry.queries()["find_faces_all"](spark, SF).collect()}
    assert got == {i: at.get(frozenset((i, i - 1, i - 1001)), -1) for i in v}


def test_every_hole_of_the_perforated_grid_is_filled(spark):
    m = X.grid(spark, SF, (F.col("i") * 31 + F.col("j") * 17) % 11 != 0, "consistent")
    n = {r["loop"]: r["count"] for r in kernels.split_loops(m).groupBy("loop").count().collect()}
    got = {}
    for r in registry.queries()["fill_holes_all"](spark, SF).collect():
        got[r["loop"]] = got.get(r["loop"], 0) + 1
    assert len(n) > 2 and got == {k: c - 2 for k, c in n.items() if k > 0 and c > 2}


def test_energies_take_every_point(spark):
    p = {}
    for r in X.points(spark, SF).collect():
        p.setdefault(r["mesh_id"], []).append((r["vid"], r["x"], r["y"], r["z"]))
    got = {r["pid"]: r["energy"] for r in registry.queries()["bending_energy"](spark, SF).collect()}
    assert set(got) == set(p)
    for k, rows in p.items():
        a = np.array([x[1:] for x in sorted(rows)])
        b = np.stack([a[:, 0] * 2, a[:, 1] + a[:, 0] ** 2, a[:, 2]], axis=1)
        assert abs(got[k] - kernels.bending_energy(a, b)) < 1e-4


def test_registration_takes_every_vertex(spark, monkeypatch):
    seen, icp = [], frames.icp
    monkeypatch.setattr(frames, "icp", lambda source, target, rounds: seen.append(source.count()) or icp(source, target, rounds))
    rows = registry.queries()["icp_fit"](spark, SF).collect()
    assert seen == [X.grid(spark, SF).vertices.count()]
    assert len(rows) > 0 and all(math.isfinite(r["value"]) for r in rows)


def test_a_table_read_in_another_order_is_the_same_mesh(spark, tmp_path):
    # means between two rounded heights: a sum's last digit decides, and with it the order of its rows
    prices, found = np.random.default_rng(5), []
    while len(found) < 4:
        c = prices.integers(100_000, 9_000_000, 10)
        c[9] += (50 - c.sum()) % 100
        a = c / 100
        up, down = (float(np.cumsum(x)[-1]) / 10 / 1000 for x in (a, np.sort(a)))
        if int((up % 1) * 10_000 + 0.5) != int((down % 1) * 10_000 + 0.5):
            found.append(a.tolist())
    for name, order in (("one", list), ("other", sorted)):
        rows = [(float(k // 2 + 1), x, (k % 2) / 100) for k, a in enumerate(found) for x in order(a)]
        spark.createDataFrame(rows, "l_quantity double, l_extendedprice double, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
    one, other = (X.grid(spark, f"{tmp_path}/{name}") for name in ("one", "other"))
    assert sorted(one.vertices.collect()) == sorted(other.vertices.collect())
    s = topology.summary(meshes.union(one, other)).first()
    assert (s["n_v"], s["n_f"]) == (4, 2)


def test_heights_that_are_no_decimals(spark, tmp_path):
    rows = [(1.0, math.nan, 0.0), (1.0, 5.0, 0.0), (2.0, None, 0.0), (2.0, 4000.0, 0.0), (3.0, None, 0.0), (4.0, 1e300, 0.0)]
    spark.createDataFrame(rows, "l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    z = {r["j"]: r["z"] for r in X.grid_cells(spark, str(tmp_path)).collect()}
    assert math.isnan(z[1]) and z[2] == 4.0 and z[3] is None and z[4] == 1e297


def test_energies_of_patches_larger_than_a_block(spark):
    rng = np.random.default_rng(2)
    p = {1: rng.normal(size=(170, 3)), 2: np.repeat(rng.normal(size=(90, 3)), 2, 0), 3: np.c_[rng.normal(size=(130, 2)), np.full(130, 0.5)], 4: rng.normal(size=(3, 3)), 5: rng.normal(size=(20, 3)), None: rng.normal(size=(30, 3))}
    q = {k: np.c_[a[:, 0] * 2, a[:, 1] + a[:, 0] ** 2, a[:, 2]] + rng.normal(size=a.shape) * 0.1 for k, a in p.items()}
    want = {k: kernels.bending_energy(p[k], q[k]) for k in p}
    q[5][7, 1] = math.nan
    rows = [(k, i, *map(float, a), *map(float, b)) for k in p for i, (a, b) in enumerate(zip(p[k], q[k], strict=True))]
    df = spark.createDataFrame(rows, "pid bigint, vid bigint, x double, y double, z double, tx double, ty double, tz double")
    got = {r["pid"]: r["energy"] for r in bending.energies(df, block=60).collect()}
    assert set(got) == set(p) and math.isnan(got.pop(5))
    assert all(got[k] == pytest.approx(want[k], rel=1e-8, abs=1e-9) for k in got)
