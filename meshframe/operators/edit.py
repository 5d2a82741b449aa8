"""Operators that change meshes: moves, reflection, slicing, subdivision, flips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import Vec, affine, area, field, from_barycentric, lerp, reflect, signed_distance
from ..plans.iterate import discard, stored
from ..schema import MeshFrame
from ..sources.meshes import corner_vecs, corners, soup, used_vertices
from .texture import corner_uvs, textured, used_uvs, with_corner_uvs
from .topology import EDGE, half_edges, vertex_degrees, vertex_faces


def transformed(vertices: DataFrame, matrix: Sequence[float]) -> DataFrame:
    """Positions under a 4x4 row-major matrix; further columns pass through."""
    v = affine(matrix, Vec.of())
    return vertices.withColumns(dict(zip("xyz", v, strict=True)))


def move(vertices: DataFrame, updates: DataFrame) -> DataFrame:
    """updates: mesh_id, vid, x, y, z. New positions; NaN rows are left out and positions
    that become equal do not merge vertices."""
    u = updates.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z"))).select("mesh_id", "vid", *Vec.of().columns("u"))
    out = vertices.join(u, ["mesh_id", "vid"], "left")
    return out.withColumns({a: F.coalesce(f"u{a}", a) for a in "xyz"}).select(*vertices.columns)


def swap(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: mesh_id, a, b. The two vertices of each pair change places."""
    both = pairs.select("mesh_id", F.explode(F.array(F.struct(F.col("a").alias("vid"), F.col("b").alias("s")), F.struct(F.col("b").alias("vid"), F.col("a").alias("s")))).alias("p")).select("mesh_id", "p.*")
    there = vertices.select("mesh_id", F.col("vid").alias("s"), *Vec.of().columns())
    return move(vertices, both.join(there, ["mesh_id", "s"]).select("mesh_id", "vid", "x", "y", "z"))


def scale(vertices: DataFrame, factors: DataFrame) -> DataFrame:
    """factors: mesh_id, vid, s. Positions multiplied; NaN factors change nothing."""
    f = factors.where(~F.isnan("s")).select("mesh_id", "vid", "s")
    out = vertices.join(f, ["mesh_id", "vid"], "left")
    return out.withColumns({a: F.col(a) * F.coalesce("s", F.lit(1.0)) for a in "xyz"}).select(*vertices.columns)


def inverted(faces: DataFrame) -> DataFrame:
    """All faces turned over."""
    return faces.withColumns({"v0": F.col("v2"), "v2": F.col("v0")})


def reverse(faces: DataFrame, ids: DataFrame) -> DataFrame:
    """Some faces (mesh_id, fid) turned over."""
    turn = ids.select("mesh_id", "fid").distinct().withColumn("_t", F.lit(True))
    out = faces.join(turn, ["mesh_id", "fid"], "left")
    return out.withColumns({"v0": F.when(F.col("_t"), F.col("v2")).otherwise(F.col("v0")), "v2": F.when(F.col("_t"), F.col("v0")).otherwise(F.col("v2"))}).select(*faces.columns)


def turned(mesh: MeshFrame, ids: DataFrame | None = None) -> MeshFrame:
    """Some faces (mesh_id, fid; all by default) turned over, and their UVs with them."""
    if ids is None:
        ids = mesh.faces
    out = mesh.with_(faces=reverse(mesh.faces, ids))
    if mesh.face_uvs is None:
        return out
    named = mesh.face_uvs.withColumnsRenamed({f"uv{k}": f"v{k}" for k in range(3)})
    return out.with_(face_uvs=reverse(named, ids).withColumnsRenamed({f"v{k}": f"uv{k}" for k in range(3)}))


def reflected(mesh: MeshFrame, on: Sequence[float], normal: Sequence[float]) -> MeshFrame:
    """Mirrored in a plane; faces are turned over, so that they still face outwards."""
    v = reflect(Vec.of(), Vec(*on), Vec(*normal).unit())
    return turned(mesh.with_(vertices=mesh.vertices.withColumns(dict(zip("xyz", v, strict=True)))))


def facet_cuts(mesh: MeshFrame, on: Sequence[float], normal: Sequence[float]) -> DataFrame:
    """Each face against a plane: how many corners are inside (at a distance of 0 or more),
    half (-1 outside, 0 cut, 1 inside), and for cut faces the lone corner a, the others in
    the face's order, and the cut points on ab and ac."""
    o, n = Vec(*on), Vec(*normal).unit()
    p = corner_vecs()
    d = [signed_distance(x, o, n) for x in p]
    f = corners(mesh.vertices, mesh.faces)
    f = f.select("*", *[c.alias(f"d{k}") for k, c in enumerate(d)])
    inside = [F.col(f"d{k}") >= 0 for k in range(3)]
    n_in = sum((i.cast("int") for i in inside), F.lit(0))
    f = f.withColumn("n_in", n_in)
    lone = F.when(F.col("n_in") == 1, F.when(inside[0], 0).when(inside[1], 1).otherwise(2)).when(F.col("n_in") == 2, F.when(~inside[0], 0).when(~inside[1], 1).otherwise(2))
    f = f.withColumn("lone", lone)
    turn = [F.struct(*[F.struct(F.col(f"v{(k + s) % 3}").alias("vid"), *Vec.of(suffix=str((k + s) % 3)).columns(), F.col(f"d{(k + s) % 3}").alias("d")).alias(name) for s, name in enumerate("abc")]) for k in range(3)]
    f = f.withColumn("r", F.when(F.col("lone") == 0, turn[0]).when(F.col("lone") == 1, turn[1]).when(F.col("lone") == 2, turn[2]))
    a, b, c = (field(F.col(f"r.{s}")) for s in "abc")
    at = lambda s: F.try_divide(F.col("r.a.d"), F.col("r.a.d") - F.col(f"r.{s}.d"))
    half = F.when(F.col("n_in") == 3, 1).when(F.col("n_in") == 0, -1).otherwise(0)
    return f.select("mesh_id", "fid", "v0", "v1", "v2", *[x for q in range(3) for x in Vec.of(suffix=str(q)).columns(suffix=str(q))], half.alias("half"), "n_in", "r", lerp(a, b, at("b")).struct().alias("ab"), lerp(a, c, at("c")).struct().alias("ac"))


def slice_soup(mesh: MeshFrame, on: Sequence[float], normal: Sequence[float]) -> DataFrame:
    """The part of the surface on the side of the plane that its normal points to, as
    triangles (mesh_id, src, part, x0..z2): whole faces, one piece of a face with a lone
    corner inside, two pieces (cut along the shorter diagonal) of one with two inside."""
    f = facet_cuts(mesh, on, normal)
    whole = tuple(field(F.struct(*Vec.of(suffix=str(k)).columns())) for k in range(3))
    a, b, c = (field(F.col(f"r.{s}")) for s in "abc")
    ab, ac = field(F.col("ab")), field(F.col("ac"))
    tri = lambda *p: F.struct(*[x for k, q in enumerate(p) for x in q.columns(suffix=str(k))])
    short = (ab - c).norm2() <= (ac - b).norm2()
    two = F.when(short, F.array(tri(ab, b, c), tri(ab, c, ac))).otherwise(F.array(tri(ab, b, ac), tri(b, c, ac)))
    parts = F.when(F.col("n_in") == 3, F.array(tri(*whole))).when(F.col("n_in") == 1, F.array(tri(a, ab, ac))).when(F.col("n_in") == 2, two)
    out = f.where("n_in > 0").select("mesh_id", F.col("fid").alias("src"), F.posexplode(parts).alias("part", "t")).select("mesh_id", "src", "part", "t.*")
    return out.where(area(*corner_vecs()) > 0)


def sliced(mesh: MeshFrame, on: Sequence[float], normal: Sequence[float]) -> MeshFrame:
    """``slice_soup`` with shared vertices. Materials stay, and pieces of textured faces have
    the UVs that their corners have on the face."""
    out = soup(slice_soup(mesh, on, normal).withColumn("fid", F.col("src") * 2 + F.col("part")))
    if textured(mesh):
        out = out.with_(vertices=stored(out.vertices), faces=stored(out.faces))  # read again for the UVs
    return uvs_by_place(mesh, out.with_(materials=mesh.materials), F.floor(F.col("fid") / 2))


def uvs_by_place(old: MeshFrame, new: MeshFrame, source: Column) -> MeshFrame:
    """The new mesh, whose faces lie on faces of the old one (``source``: their ids, from
    the new fid), with the UVs that its corners have there."""
    if not textured(old):
        return new
    from ..functions.vec import barycentric

    slots = new.faces.select("mesh_id", F.col("fid").alias("new"), source.cast("bigint").alias("fid"), F.posexplode(F.array("v0", "v1", "v2")).alias("slot", "vid"))
    at = slots.join(new.vertices.select("mesh_id", "vid", *Vec.of().columns("p")), ["mesh_id", "vid"]).join(corners(old.vertices, old.faces), ["mesh_id", "fid"])
    b = barycentric(Vec.of("p"), *corner_vecs())
    at = at.select("mesh_id", "fid", "new", "slot", *[c.alias(f"b{k}") for k, c in enumerate(b)])
    own = corner_uvs(old).groupBy("mesh_id", "mid", "fid").agg(*[F.max(F.when(F.col("slot") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in "uv"])
    mix = lambda c: sum((F.col(f"b{k}") * F.col(f"{c}{k}") for k in range(3)), F.lit(0.0)).alias(c)
    return with_corner_uvs(new, at.join(own, ["mesh_id", "fid"]).select("mesh_id", "mid", F.col("new").alias("fid"), "slot", mix("u"), mix("v")))


def subdivided(mesh: MeshFrame, points: DataFrame | None = None) -> MeshFrame:
    """Each face with a point (mesh_id, fid, x, y, z; all centroids by default) becomes
    three around a new vertex, with the winding kept. New ids follow the old ones. A new
    corner of a textured face has the UV that its point has on the face."""
    f = corners(mesh.vertices, mesh.faces)
    a, b, c = corner_vecs()
    if points is None:
        f = f.select("*", *((a + b + c) * (1 / 3)).columns("p"))
    else:
        f = f.join(points.select("mesh_id", "fid", *Vec.of().columns("p")), ["mesh_id", "fid"], "left")
    top = mesh.vertices.groupBy("mesh_id").agg(F.max("vid").alias("_tv"))
    f = f.join(top, "mesh_id").withColumn("nv", F.when(F.col("px").isNotNull(), F.col("_tv") + 1 + F.col("fid")))
    new = f.where("nv is not null").select("mesh_id", F.col("nv").alias("vid"), *[F.col(f"p{k}").alias(k) for k in "xyz"])
    one = lambda fid, *v: F.struct(fid.alias("fid"), *[F.col(x).alias(f"v{k}") for k, x in enumerate(v)])
    three = F.array(*[one(F.col("fid") * 3 + k, f"v{k}", f"v{(k + 1) % 3}", "nv") for k in range(3)])
    parts = F.when(F.col("nv").isNotNull(), three).otherwise(F.array(one(F.col("fid") * 3, "v0", "v1", "v2")))
    faces = f.select("mesh_id", F.explode(parts).alias("t")).select("mesh_id", "t.*")
    out = mesh.with_(vertices=mesh.vertices.select("mesh_id", "vid", "x", "y", "z").unionByName(new), faces=faces)
    if not textured(mesh):
        return out
    at = texture_points(mesh, f.where("nv is not null").select(F.col("fid").alias("qid"), "mesh_id", "fid", *[F.col(f"p{k}").alias(k) for k in "xyz"]))
    old = corner_uvs(mesh)
    was = F.floor(F.col("fid") / 3).cast("bigint")
    slots = faces.select("mesh_id", F.col("fid").alias("new"), was.alias("fid"), F.posexplode(F.array("v0", "v1", "v2")).alias("slot", "vid"))
    kept = slots.join(old.drop("slot"), ["mesh_id", "fid", "vid"]).select("mesh_id", "mid", F.col("new").alias("fid"), "slot", "u", "v")
    mids = old.select("mesh_id", "fid", "mid").distinct()
    made = slots.where("slot = 2").join(f.where("nv is not null").select("mesh_id", F.col("nv").alias("vid")), ["mesh_id", "vid"]).join(at.select("mesh_id", "fid", "u", "v"), ["mesh_id", "fid"]).join(mids, ["mesh_id", "fid"])
    return with_corner_uvs(out, kept.unionByName(made.select("mesh_id", "mid", F.col("new").alias("fid"), "slot", "u", "v")))


def split_midpoints(mesh: MeshFrame) -> MeshFrame:
    """Each face becomes four by its edges' midpoints; edges share their midpoints. Corners
    of textured faces have the UVs that they have on the face."""
    h = half_edges(mesh.faces)
    e = h.select(*EDGE).distinct()
    top = mesh.vertices.groupBy("mesh_id").agg(F.max("vid").alias("_tv"))
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("mesh_id").orderBy("u", "w"))).join(top, "mesh_id").withColumn("m", F.col("_tv") + F.col("k"))
    at = mesh.vertices
    p = e.join(at.select("mesh_id", F.col("vid").alias("u"), *Vec.of().columns("a")), ["mesh_id", "u"]).join(at.select("mesh_id", F.col("vid").alias("w"), *Vec.of().columns("b")), ["mesh_id", "w"])
    new = p.select("mesh_id", F.col("m").alias("vid"), *((Vec.of("a") + Vec.of("b")) * 0.5).columns())
    mids = h.join(e.select(*EDGE, "m"), EDGE).groupBy("mesh_id", "fid").agg(*[F.max(F.when(F.col("slot") == k, F.col("m"))).alias(f"m{k}") for k in range(3)])
    f = mesh.faces.join(mids, ["mesh_id", "fid"])
    one = lambda k, *v: F.struct((F.col("fid") * 4 + k).alias("fid"), *[F.col(x).alias(f"v{i}") for i, x in enumerate(v)])
    parts = F.array(one(0, "v0", "m0", "m2"), one(1, "m0", "v1", "m1"), one(2, "m2", "m1", "v2"), one(3, "m0", "m1", "m2"))
    faces = f.select("mesh_id", F.explode(parts).alias("t")).select("mesh_id", "t.*")
    out = mesh.with_(vertices=at.select("mesh_id", "vid", "x", "y", "z").unionByName(new), faces=faces)
    return uvs_by_place(mesh, out, F.floor(F.col("fid") / 4))


def split_to_area(mesh: MeshFrame, most: float) -> MeshFrame:
    """Centroid splits until no face's area exceeds ``most``: a round divides areas by three."""
    if most <= 0:
        raise ValueError("areas can't shrink to 0")
    while True:
        a, b, c = corner_vecs()
        big = corners(mesh.vertices, mesh.faces).where(area(a, b, c) > most)
        points = big.select("mesh_id", "fid", *((a + b + c) * (1 / 3)).columns())
        if not points.take(1):
            break
        new = subdivided(mesh, points)
        mesh = mesh.with_(vertices=stored(new.vertices), faces=stored(new.faces))
    return mesh


def independent_edges(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: mesh_id, u, w, any edges. A largest choice (none can be added) of those with
    exactly two faces of which no two share a face: mesh_id, u, w.

    Each edge has a priority by hash. In a round those go in that come first at both their
    faces, and all that share a face with them go out; rounds grow with the logarithm."""
    h = half_edges(faces).join(pairs.select(*EDGE).distinct(), EDGE, "left_semi").select(*EDGE, "fid")
    two = h.groupBy(*EDGE).agg(F.count("*").alias("n"), F.collect_list("fid").alias("fids")).where("n = 2")
    left = stored(two.select(*EDGE, F.explode("fids").alias("fid"), F.xxhash64(*EDGE).alias("rank")))
    out = None
    while not left.isEmpty():
        first = left.groupBy("mesh_id", "fid").agg(F.min(F.struct("rank", "u", "w")).alias("f"))
        mine = F.struct("rank", "u", "w")
        won = left.join(first, ["mesh_id", "fid"]).groupBy(*EDGE).agg(F.bool_and(mine == F.col("f")).alias("won")).where("won").select(*EDGE)
        won = stored(won)
        shut = left.join(won, EDGE, "left_semi").select("mesh_id", "fid").distinct()
        lost = left.join(shut, ["mesh_id", "fid"], "left_semi").select(*EDGE).distinct()
        last, left = left, stored(left.join(lost, EDGE, "left_anti"))
        discard(last)
        out = won if out is None else out.unionByName(won)
    return out if out is not None else left.select(*EDGE)


def flip_all(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: mesh_id, u, w, any edges. Each is flipped once, if it is an edge of two faces
    when its turn comes: a round flips independent ones, the others wait."""
    faces, left = stored(faces.select("mesh_id", "fid", "v0", "v1", "v2")), stored(pairs.select(*EDGE).distinct())
    while True:
        turn = stored(independent_edges(faces, left))
        if turn.isEmpty():
            return faces
        last, faces = (faces, left), stored(flipped(faces, turn))
        left = stored(left.join(turn, EDGE, "left_anti"))
        discard(*last)


def flipped(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: mesh_id, u, w, edges of which no two share a face (see ``independent_edges``,
    ``flip_all``). Each with exactly two faces is replaced by the other diagonal; face ids stay."""
    h = half_edges(faces).join(pairs.select(*EDGE).distinct(), EDGE, "left_semi")
    two = h.groupBy(*EDGE).agg(F.count("*").alias("n"), F.min(F.struct("fid", "a", "b", "o")).alias("p"), F.max(F.struct("fid", "a", "b", "o")).alias("q")).where("n = 2 and p.o <> q.o")
    row = lambda fid, *v: F.struct(F.col(fid).alias("fid"), *[F.col(x).alias(f"n{k}") for k, x in enumerate(v)])
    new = two.select("mesh_id", F.explode(F.array(row("p.fid", "p.o", "p.a", "q.o"), row("q.fid", "q.o", "p.b", "p.o"))).alias("t")).select("mesh_id", "t.*")
    out = faces.join(new, ["mesh_id", "fid"], "left")
    return out.withColumns({f"v{k}": F.coalesce(f"n{k}", f"v{k}") for k in range(3)}).select(*faces.columns)


def flipped_mesh(mesh: MeshFrame, pairs: DataFrame) -> MeshFrame:
    """``flipped`` with UVs: corners that a face keeps keep theirs, the new corner takes the
    UV that its vertex has in the other face; where the two faces have different materials
    (or one has none), both lose their UVs."""
    faces = flipped(mesh.faces, pairs)
    out = mesh.with_(faces=faces)
    if not textured(mesh):
        return out
    h = half_edges(mesh.faces).join(pairs.select(*EDGE).distinct(), EDGE, "left_semi")
    two = h.groupBy(*EDGE).agg(F.count("*").alias("n"), F.min(F.struct("fid", "o")).alias("p"), F.max(F.struct("fid", "o")).alias("q")).where("n = 2 and p.o <> q.o")
    other = two.select("mesh_id", F.explode(F.array(F.struct(F.col("p.fid").alias("fid"), F.col("q.fid").alias("mate")), F.struct(F.col("q.fid").alias("fid"), F.col("p.fid").alias("mate")))).alias("t")).select("mesh_id", "t.*")
    old = corner_uvs(mesh)
    slots = faces.select("mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("slot", "vid")).join(other, ["mesh_id", "fid"], "left")
    mine = old.select("mesh_id", "fid", "vid", F.struct("mid", "u", "v").alias("own"))
    mates = old.select("mesh_id", F.col("fid").alias("mate"), "vid", F.struct("mid", "u", "v").alias("far"))
    kind = old.select("mesh_id", "fid", "mid").distinct()
    same = other.join(kind, ["mesh_id", "fid"]).join(kind.withColumnsRenamed({"fid": "mate", "mid": "mid2"}), ["mesh_id", "mate"]).where("mid = mid2").select("mesh_id", "fid", F.lit(True).alias("same"))
    rows = slots.join(mine, ["mesh_id", "fid", "vid"], "left").join(mates, ["mesh_id", "mate", "vid"], "left").join(same, ["mesh_id", "fid"], "left")
    rows = rows.where("mate is null or same").withColumn("t", F.coalesce("own", "far")).where("t is not null")
    return with_corner_uvs(out, rows.select("mesh_id", "t.mid", "fid", "slot", "t.u", "t.v"))


def without_tetrahedra(mesh: MeshFrame) -> MeshFrame:
    """One round: vertices with exactly three faces and three neighbours go, and their
    faces are replaced by the base unless it is there. Of neighbouring such vertices the
    least goes, so the round is a set of independent changes. Faces that go take their UVs
    along; where all three have one material, the base has it, and at each corner the UV
    of the least of them."""
    from .topology import neighbours

    apex = vertex_degrees(mesh.faces).where("n_faces = 3 and n_neighbours = 3").select("mesh_id", "vid")
    near = neighbours(mesh.faces).join(apex, ["mesh_id", "vid"], "left_semi").join(apex.withColumnRenamed("vid", "nbr"), ["mesh_id", "nbr"], "left_semi").where("nbr < vid")
    apex = apex.join(near.select("mesh_id", "vid").distinct(), ["mesh_id", "vid"], "left_anti")
    touching = vertex_faces(mesh.faces).join(apex, ["mesh_id", "vid"], "left_semi")
    rim = half_edges(mesh.faces).join(apex.withColumnRenamed("vid", "o"), ["mesh_id", "o"], "left_semi")
    base = rim.groupBy("mesh_id", "o").agg(F.min("fid").alias("fid"), F.min(F.struct("fid", "a", "b")).alias("e"), F.collect_set("a").alias("all"))
    third = F.element_at(F.array_except("all", F.array("e.a", "e.b")), 1)
    base = base.select("mesh_id", "fid", F.col("e.a").alias("v0"), F.col("e.b").alias("v1"), third.alias("v2"))
    key = F.array_sort(F.array("v0", "v1", "v2")).alias("_k")
    kept = mesh.faces.select("mesh_id", "fid", "v0", "v1", "v2").join(touching.select("mesh_id", "fid").distinct(), ["mesh_id", "fid"], "left_anti")
    base = base.select("*", key).join(kept.select("mesh_id", key), ["mesh_id", "_k"], "left_anti").drop("_k")
    out = mesh.with_(vertices=mesh.vertices.join(apex, ["mesh_id", "vid"], "left_anti"), faces=kept.unionByName(base))
    if not textured(mesh):
        return out
    old = corner_uvs(mesh)
    gone = touching.select("mesh_id", "fid", F.col("vid").alias("apex"))
    lost = old.join(gone, ["mesh_id", "fid"])
    rim = lost.groupBy("mesh_id", "apex").agg(F.min("mid").alias("mid"), (F.min("mid") == F.max("mid")).alias("one"), F.countDistinct("fid").alias("n"), F.min("fid").alias("least")).where("one and n = 3")
    at = lost.where("vid <> apex").groupBy("mesh_id", "apex", "vid").agg(F.min(F.struct("fid", "u", "v")).alias("t"))
    of = gone.groupBy("mesh_id", "apex").agg(F.min("fid").alias("fid"))
    slots = base.select("mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("slot", "vid"))
    made = slots.join(of, ["mesh_id", "fid"]).join(rim.select("mesh_id", "apex", "mid"), ["mesh_id", "apex"]).join(at, ["mesh_id", "apex", "vid"]).select("mesh_id", "mid", "fid", "slot", "t.u", "t.v")
    stay = old.join(gone.select("mesh_id", "fid").distinct(), ["mesh_id", "fid"], "left_anti").select("mesh_id", "mid", "fid", "slot", "u", "v")
    return with_corner_uvs(out, stay.unionByName(made))


def split_irregular(mesh: MeshFrame) -> MeshFrame:
    """At edges of three or more faces the two flattest stay joined; each other face gets
    copies of the edge's vertices."""
    from .graph import flattest_pairs

    h = half_edges(mesh.faces)
    many = h.groupBy(*EDGE).agg(F.count("*").alias("n")).where("n > 2").select(*EDGE)
    loose = h.join(many, EDGE, "left_semi").join(flattest_pairs(mesh), [*EDGE, "fid"], "left_anti")
    top = mesh.vertices.groupBy("mesh_id").agg(F.max("vid").alias("_tv"))
    ends = loose.select("mesh_id", "fid", F.explode(F.array("a", "b")).alias("vid")).distinct()
    ends = ends.withColumn("k", F.row_number().over(Window.partitionBy("mesh_id").orderBy("fid", "vid"))).join(top, "mesh_id").withColumn("new", F.col("_tv") + F.col("k"))
    v = mesh.vertices.select("mesh_id", "vid", "x", "y", "z")
    copies = ends.join(v, ["mesh_id", "vid"]).select("mesh_id", F.col("new").alias("vid"), "x", "y", "z")
    f = mesh.faces
    for k in range(3):
        f = f.join(ends.select("mesh_id", "fid", F.col("vid").alias(f"v{k}"), F.col("new").alias(f"n{k}")), ["mesh_id", "fid", f"v{k}"], "left")
    f = f.select("mesh_id", "fid", *[F.coalesce(f"n{k}", f"v{k}").alias(f"v{k}") for k in range(3)])
    return mesh.with_(vertices=v.unionByName(copies), faces=f)


def collapsed(mesh: MeshFrame, ids: DataFrame) -> MeshFrame:
    """Some faces (mesh_id, fid; no two with a common vertex) shrink to their centroids;
    faces that lose a corner go, and their UVs; corners of the others keep theirs."""
    from ..sources.meshes import valid_faces

    a, b, c = corner_vecs()
    f = corners(mesh.vertices, mesh.faces).join(ids.select("mesh_id", "fid").distinct(), ["mesh_id", "fid"], "left_semi")
    to = f.select("mesh_id", F.col("v0").alias("t"), F.explode(F.array("v0", "v1", "v2")).alias("vid"), ((a + b + c) * (1 / 3)).struct().alias("p"))
    v = move(mesh.vertices, to.where("vid = t").select("mesh_id", "vid", "p.*"))
    out = mesh.faces
    for k in range(3):
        out = out.join(to.select("mesh_id", F.col("vid").alias(f"v{k}"), F.col("t").alias(f"t{k}")), ["mesh_id", f"v{k}"], "left")
    out = out.select("mesh_id", "fid", *[F.coalesce(f"t{k}", f"v{k}").alias(f"v{k}") for k in range(3)])
    out = valid_faces(v, out)
    return used_uvs(mesh.with_(vertices=used_vertices(v, out), faces=out))


def texture_points(mesh: MeshFrame, points: DataFrame) -> DataFrame:
    """points: qid, mesh_id, fid, x, y, z. UVs by barycentric interpolation; (-1, -1) on a
    face without material."""
    from ..functions.vec import barycentric

    f = corners(mesh.vertices, mesh.faces).join(points.select("qid", "mesh_id", "fid", *Vec.of().columns("p")), ["mesh_id", "fid"])
    u, v, w = barycentric(Vec.of("p"), *corner_vecs())
    f = f.select("qid", "mesh_id", "fid", u.alias("b0"), v.alias("b1"), w.alias("b2"))
    t = mesh.face_uvs
    for k in range(3):
        t = t.join(mesh.uvs.select("mesh_id", "mid", F.col("uvid").alias(f"uv{k}"), F.col("u").alias(f"s{k}"), F.col("v").alias(f"t{k}")), ["mesh_id", "mid", f"uv{k}"])
    out = f.join(t, ["mesh_id", "fid"], "left")
    mix = lambda s: F.coalesce(sum((F.col(f"b{k}") * F.col(f"{s}{k}") for k in range(3)), F.lit(0.0)), F.lit(-1.0))
    return out.select("qid", "mesh_id", "fid", mix("s").alias("u"), mix("t").alias("v"))


def barycentric_round_trip(mesh: MeshFrame, points: DataFrame) -> DataFrame:
    """points: qid, mesh_id, fid, x, y, z: coordinates on the face and the point they give."""
    from ..functions.vec import barycentric

    f = corners(mesh.vertices, mesh.faces).join(points.select("qid", "mesh_id", "fid", *Vec.of().columns("p")), ["mesh_id", "fid"])
    b = barycentric(Vec.of("p"), *corner_vecs())
    return f.select("qid", *[c.alias(f"b{k}") for k, c in enumerate(b)], *from_barycentric(*b, *corner_vecs()).columns())
