"""Graph operators: components, manifolds, winding, loops, distances, regions.

Loops run over written tables; each round is joins and aggregates over all meshes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import Vec, angle, field
from ..plans.iterate import discard, fixpoint, stored
from ..schema import MeshFrame
from ..sources.meshes import corner_vecs, corners, face_subset
from .topology import EDGE, boundary_edges, boundary_vertices, dual_edges, edges, half_edges, neighbours, vertex_faces


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links: mesh_id, a, b; nodes: mesh_id, node. Adds root, the least node that each
    reaches. Alternating large and small stars: the rounds grow with the logarithm."""
    now = stored(links.where("a <> b").select("mesh_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def step(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select("mesh_id", F.col("b").alias("a"), F.col("a").alias("b")))
        m = both.groupBy("mesh_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(m, ["mesh_id", "a"]).where("b > a").select("mesh_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        m = large.groupBy("mesh_id", "a").agg(F.min("b").alias("m"))
        small = large.join(m, ["mesh_id", "a"]).where("b <> m").select("mesh_id", F.col("b").alias("a"), F.col("m").alias("b"))
        return small.unionByName(m.select("mesh_id", "a", F.col("m").alias("b"))).distinct()

    done = fixpoint(now, step, lambda e: tuple(e.agg(F.count("*"), F.sum("b"), F.sum(F.xxhash64("mesh_id", "a", "b") % 1000003)).first()))
    return nodes.join(done.select("mesh_id", F.col("a").alias("node"), F.col("b").alias("root")), ["mesh_id", "node"], "left").select("mesh_id", "node", F.coalesce("root", "node").alias("root"))


def flattest_pairs(mesh: MeshFrame) -> DataFrame:
    """At edges of more than two faces, the two faces that are flattest to their other
    neighbours: mesh_id, u, w, fid."""
    n = corners(mesh.vertices, mesh.faces)
    from ..functions.vec import face_vector

    n = n.select("mesh_id", "fid", face_vector(*corner_vecs()).unit().struct().alias("n"))
    h = half_edges(mesh.faces)
    many = edges(mesh.faces).where("nfaces > 2").select(*EDGE)
    at = h.join(many, EDGE, "left_semi").select(*EDGE, "fid")
    d = dual_edges(mesh.faces).select("mesh_id", F.col("f").alias("fid"), F.col("g"))
    near = at.join(n, ["mesh_id", "fid"]).join(d, ["mesh_id", "fid"], "left").join(n.select("mesh_id", F.col("fid").alias("g"), F.col("n").alias("m")), ["mesh_id", "g"], "left")
    flat = near.groupBy(*EDGE, "fid").agg(F.coalesce(F.avg(F.abs(field(F.col("n")).dot(field(F.col("m"))))), F.lit(0.0)).alias("flat"))
    rank = F.row_number().over(Window.partitionBy(*EDGE).orderBy(F.desc("flat"), "fid"))
    return flat.withColumn("r", rank).where("r <= 2").select(*EDGE, "fid")


def manifolds(mesh: MeshFrame, crossing: Column | None = None) -> DataFrame:
    """mesh_id, fid, manifold (0 is the largest; ties by least face). Faces are joined over
    edges of two faces, and at edges of more over the two flattest."""
    d = dual_edges(mesh.faces, crossing).select("mesh_id", F.col("f").alias("a"), F.col("g").alias("b"))
    p = flattest_pairs(mesh).groupBy(*EDGE).agg(F.min("fid").alias("a"), F.max("fid").alias("b")).where("a <> b").select("mesh_id", "a", "b")
    c = components(d.unionByName(p), mesh.faces.select("mesh_id", F.col("fid").alias("node")))
    size = c.groupBy("mesh_id", "root").agg(F.count("*").alias("n"))
    rank = size.withColumn("manifold", F.row_number().over(Window.partitionBy("mesh_id").orderBy(F.desc("n"), "root")) - 1)
    return c.join(rank, ["mesh_id", "root"]).select("mesh_id", F.col("node").alias("fid"), "manifold")


def manifold_parts(mesh: MeshFrame, parts: DataFrame) -> DataFrame:
    """A row per manifold: faces, vertices, boundary edges."""
    f = mesh.faces.join(parts, ["mesh_id", "fid"])
    n = f.groupBy("mesh_id", "manifold").agg(F.count("*").alias("n_faces"))
    v = f.select("mesh_id", "manifold", F.explode(F.array("v0", "v1", "v2")).alias("vid")).groupBy("mesh_id", "manifold").agg(F.countDistinct("vid").alias("n_vertices"))
    e = half_edges(mesh.faces).join(parts, ["mesh_id", "fid"]).groupBy("mesh_id", "manifold", "u", "w").agg(F.count("*").alias("k")).groupBy("mesh_id", "manifold").agg(F.count_if(F.col("k") % 2 == 1).alias("n_boundary"))
    return n.join(v, ["mesh_id", "manifold"]).join(e, ["mesh_id", "manifold"])


def largest_manifolds(mesh: MeshFrame, n: int) -> MeshFrame:
    """The n largest manifolds (one at least) as a mesh."""
    return face_subset(mesh, manifolds(mesh).where(F.col("manifold") < max(n, 1)))


def winding(mesh: MeshFrame) -> tuple[DataFrame, DataFrame]:
    """Consistent windings: mesh_id, fid, root, sign (-1: to be turned over so that a
    component winds as its least face does), and per component whether it is twisted; then
    no signs fit and all are 1.

    Each face stands twice, as it is (2 fid) and turned over (2 fid + 1), and faces meet
    as they wind alike. A component then falls into two halves, or into one if it is
    twisted; finding them takes a logarithm of rounds."""
    d = dual_edges(mesh.faces).select("mesh_id", "f", "g", F.when(F.col("same"), 0).otherwise(1).alias("turn"))
    links = d.select("mesh_id", F.explode(F.array(*[F.struct((2 * F.col("f") + k).alias("a"), (2 * F.col("g") + F.col("turn").bitwiseXOR(F.lit(k))).alias("b")) for k in (0, 1)])).alias("l")).select("mesh_id", "l.*")
    nodes = mesh.faces.select("mesh_id", F.explode(F.array(2 * F.col("fid"), 2 * F.col("fid") + 1)).alias("node"))
    c = stored(components(links, nodes))
    fid = F.shiftright("node", 1)
    both = c.groupBy("mesh_id", fid.alias("fid")).agg(F.max(F.when(F.col("node") % 2 == 0, F.col("root"))).alias("up"), F.max(F.when(F.col("node") % 2 == 1, F.col("root"))).alias("down"))
    twisted = F.col("up") == F.col("down")
    signs = both.select("mesh_id", "fid", F.shiftright("up", 1).alias("root"), F.when(twisted | (F.col("up") % 2 == 0), 1).otherwise(-1).alias("sign"))
    return signs, both.groupBy("mesh_id", F.shiftright("up", 1).alias("root")).agg(F.bool_or(twisted).alias("twisted"))


def boundary_loops(mesh: MeshFrame) -> DataFrame:
    """A row per component of the boundary: mesh_id, loop (its least vertex), n (edges),
    simple (does each of its vertices have two boundary edges)."""
    b = stored(boundary_edges(mesh.faces))
    ends = b.select("mesh_id", F.explode(F.array("u", "w")).alias("node"))
    degree = ends.groupBy("mesh_id", "node").agg(F.count("*").alias("d"))
    c = components(b.select("mesh_id", F.col("u").alias("a"), F.col("w").alias("b")), degree.select("mesh_id", "node")).join(degree, ["mesh_id", "node"])
    return c.groupBy("mesh_id", F.col("root").alias("loop")).agg((F.sum("d") / 2).cast("bigint").alias("n"), (F.max("d") == 2).alias("simple"))


def ordered_loops(mesh: MeshFrame) -> DataFrame:
    """Simple loops in order: mesh_id, loop, pos, vid. Positions come from pointer doubling
    along the boundary's half-edges, so a long loop takes a logarithm of rounds. Loops
    with a vertex of more than one way on are left to ``kernels.split_loops``."""
    b = half_edges(mesh.faces).join(boundary_edges(mesh.faces), EDGE, "left_semi").select("mesh_id", F.col("a").alias("vid"), F.col("b").alias("nxt"))
    loops = boundary_loops(mesh).where("simple")
    ends = boundary_edges(mesh.faces)
    comp = components(ends.select("mesh_id", F.col("u").alias("a"), F.col("w").alias("b")), ends.select("mesh_id", F.explode(F.array("u", "w")).alias("node")).distinct())
    s = b.join(comp.select("mesh_id", F.col("node").alias("vid"), F.col("root").alias("loop")), ["mesh_id", "vid"]).join(loops.select("mesh_id", "loop", "n"), ["mesh_id", "loop"])
    # steps to the loop's least vertex
    s = s.select("mesh_id", "vid", "loop", "n", F.when(F.col("vid") == F.col("loop"), F.col("vid")).otherwise(F.col("nxt")).alias("nxt"), F.when(F.col("vid") == F.col("loop"), 0).otherwise(1).cast("bigint").alias("dist"))

    def step(t: DataFrame) -> DataFrame:
        on = t.select("mesh_id", F.col("vid").alias("nxt"), F.col("nxt").alias("far"), F.col("dist").alias("more"))
        return t.join(on, ["mesh_id", "nxt"]).select("mesh_id", "vid", "loop", "n", F.col("far").alias("nxt"), (F.col("dist") + F.col("more")).alias("dist"))

    done = fixpoint(s, step, lambda t: tuple(t.agg(F.sum("nxt"), F.sum("dist")).first()))
    return done.select("mesh_id", "loop", F.pmod(F.col("n") - F.col("dist"), F.col("n")).alias("pos"), "vid")


def weighted_edges(mesh: MeshFrame, cost: Callable[[Vec, Vec], Column] | None = None) -> DataFrame:
    """mesh_id, vid, nbr, w: both directions of each edge; a length by default."""
    cost = cost or (lambda a, b: (b - a).norm())
    v = mesh.vertices
    e = neighbours(mesh.faces).join(v.select("mesh_id", "vid", *Vec.of().columns("a")), ["mesh_id", "vid"]).join(v.select("mesh_id", F.col("vid").alias("nbr"), *Vec.of().columns("b")), ["mesh_id", "nbr"])
    return e.select("mesh_id", "vid", "nbr", cost(Vec.of("a"), Vec.of("b")).alias("w"))


def distances(links: DataFrame, sources: DataFrame) -> DataFrame:
    """links: mesh_id, vid, nbr, w; sources: mesh_id, src. Least cost from each source:
    mesh_id, src, vid, d, prev (of equal costs the least vertex before; null at the source).
    Each round relaxes only from vertices that changed."""
    links = stored(links)
    state = stored(sources.select("mesh_id", "src", F.col("src").alias("vid"), F.lit(0.0).alias("d"), F.lit(None).cast("bigint").alias("prev"), F.lit(True).alias("new")))
    while True:
        ahead = state.where("new").select("mesh_id", "src", "vid", "d").join(links, ["mesh_id", "vid"]).select("mesh_id", "src", F.col("nbr").alias("vid"), (F.col("d") + F.col("w")).alias("d"), F.col("vid").alias("prev"), F.lit(True).alias("new"))
        both = state.withColumn("new", F.lit(False)).unionByName(ahead)
        best = F.min(F.struct("d", F.coalesce("prev", F.lit(-1)).alias("p"), "prev", "new")).alias("b")
        last, state = state, stored(both.groupBy("mesh_id", "src", "vid").agg(best).select("mesh_id", "src", "vid", "b.d", "b.prev", "b.new"))
        discard(last)
        if not state.where("new").take(1):
            break
    return state.drop("new")


def paths(reached: DataFrame, pairs: DataFrame) -> DataFrame:
    """reached: what ``distances`` or ``routes.routes`` gives; pairs: mesh_id, src, dst. The
    vertices from dst back to src: mesh_id, src, dst, back, vid.

    Steps back double: a round adds, to the vertices found so far, those twice as far back,
    and squares the step, so a path takes a logarithm of rounds."""
    of = [c for c in ("mesh_id", "src", "dst") if c in reached.columns]
    step = stored(reached.where("prev is not null").select(*of, "vid", F.col("prev").alias("far")))
    ends = pairs.select("mesh_id", "src", "dst", F.lit(0).cast("bigint").alias("back"), F.col("dst").alias("vid"))
    out = stored(ends.join(reached.select(*of, "vid"), [*of, "vid"], "left_semi"))
    width = 1
    while True:
        more = stored(out.join(step, [*of, "vid"]).select("mesh_id", "src", "dst", (F.col("back") + width).alias("back"), F.col("far").alias("vid")))
        if more.isEmpty():
            return out
        last, out = out, stored(out.unionByName(more))
        discard(last, more)
        on = step.select(*of, F.col("vid").alias("far"), F.col("far").alias("next"))
        last, step = step, stored(step.join(on, [*of, "far"]).select(*of, "vid", F.col("next").alias("far")))
        discard(last)
        width *= 2


def path_lengths(points: DataFrame, by: str = "path_id", order: str = "pos") -> DataFrame:
    """Sum of the distances of consecutive points; 0 for one point."""
    w = Window.partitionBy(by).orderBy(order)
    before = Vec(*(F.lag(a).over(w) for a in "xyz"))
    return points.select(by, (Vec.of() - before).norm().alias("_d")).groupBy(by).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"))


def most_extruded(points: DataFrame, by: str = "path_id", order: str = "pos") -> DataFrame:
    """The inner point of each path farthest from its ends together (the first of equals);
    a path of three gives its middle, shorter ones -1."""
    w = Window.partitionBy(by)
    ends = [F.min(F.struct(order, "x", "y", "z")).over(w), F.max(F.struct(order, "x", "y", "z")).over(w)]
    p = points.select(by, order, "x", "y", "z", ends[0].alias("a"), ends[1].alias("b"))
    far = (Vec.of() - field(F.col("a"))).norm() + (Vec.of() - field(F.col("b"))).norm()
    inner = (F.col(order) != F.col(f"a.{order}")) & (F.col(order) != F.col(f"b.{order}"))
    best = F.max(F.when(inner, F.struct(far.alias("far"), (-F.col(order)).alias("back")))).alias("m")
    return p.groupBy(by).agg(best).select(by, F.coalesce(-F.col("m.back"), F.lit(-1)).alias(order))


def region(mesh: MeshFrame, seeds: DataFrame) -> DataFrame:
    """seeds: rid, mesh_id, fid, x, y, z, r. The vertices inside the ball that the seed
    face's inside vertices reach: rid, mesh_id, vid, front (has a neighbour outside, or
    a boundary edge). With nothing inside, the seed face's nearest vertex is the front."""
    v = mesh.vertices
    d2 = (Vec.of() - Vec.of("c")).norm2()
    near = v.join(seeds.select("rid", "mesh_id", *Vec.of().columns("c"), "r"), "mesh_id")
    inside = stored(near.where(d2 <= F.col("r") * F.col("r")).select("rid", "mesh_id", "vid"))
    links = stored(neighbours(mesh.faces))
    first = seeds.select("rid", "mesh_id", "fid").join(vertex_faces(mesh.faces), ["mesh_id", "fid"]).select("rid", "mesh_id", "vid")
    start = first.join(inside, ["rid", "mesh_id", "vid"], "left_semi")

    def step(s: DataFrame) -> DataFrame:
        more = s.join(links, ["mesh_id", "vid"]).select("rid", "mesh_id", F.col("nbr").alias("vid")).join(inside, ["rid", "mesh_id", "vid"], "left_semi")
        return s.unionByName(more).distinct()

    body = fixpoint(start, step, lambda s: (s.count(),))
    out = body.join(links, ["mesh_id", "vid"]).join(inside.select("rid", "mesh_id", F.col("vid").alias("nbr"), F.lit(True).alias("in")), ["rid", "mesh_id", "nbr"], "left")
    edge = boundary_vertices(mesh.faces).withColumn("edge", F.lit(True))
    found = out.groupBy("rid", "mesh_id", "vid").agg(F.bool_or(F.col("in").isNull()).alias("out")).join(edge, ["mesh_id", "vid"], "left").select("rid", "mesh_id", "vid", (F.col("out") | F.col("edge").isNotNull()).alias("front"))
    none = first.join(found.select("rid").distinct(), "rid", "left_anti").join(near.select("rid", "mesh_id", "vid", d2.alias("d2")), ["rid", "mesh_id", "vid"])
    none = none.groupBy("rid", "mesh_id").agg(F.min(F.struct("d2", "vid")).alias("b")).select("rid", "mesh_id", "b.vid", F.lit(True).alias("front"))
    return found.unionByName(none)


def region_faces(mesh: MeshFrame, members: DataFrame) -> DataFrame:
    """Faces that touch a vertex of a region's body."""
    return vertex_faces(mesh.faces).join(members.where("not front"), ["mesh_id", "vid"]).select("rid", "mesh_id", "fid").distinct()


def saddle_edges(mesh: MeshFrame, labels: DataFrame) -> DataFrame:
    """labels: mesh_id, vid, label. Pairs of labels (p > q) that an edge joins, with the
    number of such edges: the dual of the labels' cells."""
    e = edges(mesh.faces).select(*EDGE)
    lab = lambda v, name: labels.select("mesh_id", F.col("vid").alias(v), F.col("label").alias(name))
    j = e.join(lab("u", "lu"), ["mesh_id", "u"]).join(lab("w", "lw"), ["mesh_id", "w"]).where("lu <> lw")
    return j.groupBy("mesh_id", F.greatest("lu", "lw").alias("p"), F.least("lu", "lw").alias("q")).agg(F.count("*").alias("n"))


def farthest_samples(vertices: DataFrame, start: int, n: int) -> DataFrame:
    """Farthest-point sampling by straight distance: mesh_id, vid, label (the sample that a
    vertex is nearest to, the first of equals), d2. A round a sample."""
    pick = vertices.where(F.col("vid") == start).select("mesh_id", F.col("vid").alias("s"), *Vec.of().columns("s"))
    state = stored(vertices.select("mesh_id", "vid", "x", "y", "z", F.lit(None).cast("bigint").alias("label"), F.lit(float("inf")).alias("d2")))
    for k in range(n):
        if k:
            pick = state.groupBy("mesh_id").agg(F.max(F.struct("d2", (-F.col("vid")).alias("m"), "vid", "x", "y", "z")).alias("b")).select("mesh_id", F.col("b.vid").alias("s"), *[F.col(f"b.{a}").alias(f"s{a}") for a in "xyz"])
        j = state.join(pick, "mesh_id")
        near = (Vec.of() - Vec.of("s")).norm2()
        state = stored(j.select("mesh_id", "vid", "x", "y", "z", F.when(near < F.col("d2"), F.col("s")).otherwise(F.col("label")).alias("label"), F.least("d2", near).alias("d2")))
    return state.select("mesh_id", "vid", "label", "d2")


def interpolated(mesh: MeshFrame, labels: DataFrame) -> DataFrame:
    """labels: mesh_id, vid, label, t, f (arrival, slowness). Each vertex, weighted four
    times, averaged with the places where its front meets those of neighbours of other
    labels: mesh_id, vid, x, y, z."""
    from ..functions.vec import lerp, meeting_parameter

    v = mesh.vertices.select("mesh_id", "vid", "x", "y", "z").join(labels, ["mesh_id", "vid"])
    a = v.select("mesh_id", "vid", *Vec.of().columns("a"), F.col("label").alias("la"), F.col("t").alias("ta"), F.col("f").alias("fa"))
    b = v.select("mesh_id", F.col("vid").alias("nbr"), *Vec.of().columns("b"), F.col("label").alias("lb"), F.col("t").alias("tb"), F.col("f").alias("fb"))
    j = a.join(neighbours(mesh.faces), ["mesh_id", "vid"]).join(b, ["mesh_id", "nbr"]).where("la <> lb")
    p, q = Vec.of("a"), Vec.of("b")
    meet = lerp(p, q, meeting_parameter(F.col("ta"), F.col("tb"), F.col("fa"), F.col("fb"), (q - p).norm()))
    s = j.groupBy("mesh_id", "vid").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{k}") for c, k in zip(meet, "xyz", strict=True)])
    out = v.join(s, ["mesh_id", "vid"], "left")
    return out.select("mesh_id", "vid", *[((4 * F.col(k) + F.coalesce(f"s{k}", F.lit(0.0))) / (4 + F.coalesce("n", F.lit(0)))).alias(k) for k in "xyz"])


def corner_angles_at(mesh: MeshFrame) -> DataFrame:
    """Angle sum at each vertex (2 pi where the surface is flat)."""
    p = corner_vecs()
    rows = [F.struct(F.col(f"v{k}").alias("vid"), angle(p[(k + 1) % 3] - p[k], p[(k + 2) % 3] - p[k]).alias("t")) for k in range(3)]
    return corners(mesh.vertices, mesh.faces).select("mesh_id", F.explode(F.array(*rows)).alias("r")).groupBy("mesh_id", F.col("r.vid").alias("vid")).agg(F.sum("r.t").alias("angle"))
