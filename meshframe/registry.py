"""Queries of the mesh engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import vec
from .functions.vec import Vec
from .operators import bending, edit, frames, graph, kernels, measure, routes, spatial, surface, texture, topology
from .plans.iterate import stored
from .schema import MeshFrame
from .sources import meshes

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def xyz(prefix: str = "") -> list[Column]:
    return [r(prefix + a).alias(prefix + a) for a in "xyz"]


def rr(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n.split('.')[-1]}" for n in names)


def _grid(where: str = "", name: str = "") -> str:
    v, f, fe, e = (x + name for x in ("v", "f", "fe", "e"))
    return f"""{v} AS (SELECT CAST(i*1000+j AS BIGINT) AS vid, i, j, CAST(j AS DOUBLE) x, CAST(i AS DOUBLE) y, z FROM (
  SELECT CAST(round(l_discount*100) AS INT) i, CAST(l_quantity AS INT) j, avg(l_extendedprice)/1000 z FROM lineitem GROUP BY 1,2) g {where}),
{f} AS (SELECT 2*a.vid AS fid, a.vid v0, b.vid v1, c.vid v2 FROM {v} a JOIN {v} b ON b.i=a.i AND b.j=a.j-1 JOIN {v} c ON c.i=a.i-1 AND c.j=a.j-1
  UNION ALL SELECT 2*a.vid+1, a.vid, b.vid, c.vid FROM {v} a JOIN {v} b ON b.i=a.i-1 AND b.j=a.j JOIN {v} c ON c.i=a.i-1 AND c.j=a.j-1),
{fe} AS (SELECT fid, 0 slot, v0 a, v1 b, v2 o, least(v0,v1) u, greatest(v0,v1) w FROM {f} UNION ALL SELECT fid, 1, v1, v2, v0, least(v1,v2), greatest(v1,v2) FROM {f} UNION ALL SELECT fid, 2, v2, v0, v1, least(v2,v0), greatest(v2,v0) FROM {f}),
{e} AS (SELECT u, w, CAST(count(*) AS BIGINT) n FROM {fe} GROUP BY u, w)"""


GRID = "WITH " + _grid()
TERRAIN = GRID.replace("CAST(round(l_discount*100) AS INT) i", "CAST(l_orderkey//40 AS INT) i")
PERFORATED = "WITH " + _grid("WHERE (i*31+j*17)%11 <> 0")
STRIPS = "WITH " + _grid("WHERE j NOT IN (24,25)")
RECURSIVE_STRIPS = "WITH RECURSIVE " + _grid("WHERE j NOT IN (24,25)")
RECURSIVE_PERFORATED = "WITH RECURSIVE " + _grid("WHERE (i*31+j*17)%11 <> 0")
RECURSIVE_GRID = "WITH RECURSIVE " + _grid()
CORNERS = """, k AS (SELECT f.*, a.x x0, a.y y0, a.z z0, b.x x1, b.y y1, b.z z1, c.x x2, c.y y2, c.z z2 FROM f JOIN v a ON a.vid=v0 JOIN v b ON b.vid=v1 JOIN v c ON c.vid=v2),
fv AS (SELECT k.*, (y1-y0)*(z2-z1)-(z1-z0)*(y2-y1) nx, (z1-z0)*(x2-x1)-(x1-x0)*(z2-z1) ny, (x1-x0)*(y2-y1)-(y1-y0)*(x2-x1) nz FROM k)"""
NORMALS = """, vs AS (SELECT vid, sum(nx) sx, sum(ny) sy, sum(nz) sz FROM (SELECT unnest([v0,v1,v2]) vid, nx, ny, nz FROM fv) q GROUP BY vid),
vn AS (SELECT v.vid, v.x, v.y, v.z, sx/sqrt(sx*sx+sy*sy+sz*sz) nx, sy/sqrt(sx*sx+sy*sy+sz*sz) ny, sz/sqrt(sx*sx+sy*sy+sz*sz) nz FROM v JOIN vs USING (vid))"""
CLOUD = "WITH p AS (SELECT CAST(label AS BIGINT) mesh_id, CAST(vec_id AS BIGINT) vid, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding[3] AS DOUBLE) z FROM embeddings)"
PROBES = ", q AS (SELECT vid qid, x*40+25 qx, y*8+5 qy, z*20+50 qz FROM p WHERE vid < 40)"


# --- sources -------------------------------------------------------------------------

@query(GRID + CORNERS + """ SELECT CAST((SELECT count(*) FROM v) AS BIGINT) n_v, CAST((SELECT count(*) FROM f) AS BIGINT) n_f, CAST(count(*) AS BIGINT) n_e,
 CAST(sum(CASE WHEN n=1 THEN 1 ELSE 0 END) AS BIGINT) n_boundary, CAST(sum(CASE WHEN n>2 THEN 1 ELSE 0 END) AS BIGINT) n_irregular,
 CAST((SELECT count(*) FROM v)-count(*)+(SELECT count(*) FROM f) AS BIGINT) euler, round((SELECT sum(sqrt(nx*nx+ny*ny+nz*nz))/2 FROM fv),6) area,
 CAST((SELECT sum(CASE WHEN nz>0 THEN 1 ELSE 0 END) FROM fv) AS BIGINT) n_up FROM e""")
def grid_mesh_summary(spark, d):
    s = topology.summary(X.grid(spark, d))
    return s.select("n_v", "n_f", "n_e", "n_boundary", "n_irregular", "euler", r("area").alias("area"), "n_up")


@query(CLOUD + """, s AS (SELECT mesh_id, vid*2 ord, x, y, z FROM p UNION ALL SELECT mesh_id, vid*2+1, x+0.00001, y, z FROM p),
 k AS (SELECT *, row_number() OVER (PARTITION BY mesh_id, trunc(x)+trunc((x-trunc(x))*10000+0.5)/10000, trunc(y)+trunc((y-trunc(y))*10000+0.5)/10000, trunc(z)+trunc((z-trunc(z))*10000+0.5)/10000 ORDER BY ord) k FROM s)
 SELECT mesh_id, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY ord)-1 AS BIGINT) vid, round(x,6)+0.0 x, round(y,6)+0.0 y, round(z,6)+0.0 z FROM k WHERE k=1""")
def cloud_dedup_quantised(spark, d):
    p = X.points(spark, d)
    both = p.withColumn("ord", F.col("vid") * 2).unionByName(p.withColumn("ord", F.col("vid") * 2 + 1).withColumn("x", F.col("x") + 0.00001))
    return meshes.cloud(both).select("mesh_id", "vid", *xyz())


@query(GRID + CORNERS + " SELECT CAST((SELECT count(*) FROM v) AS BIGINT) n_v, CAST(count(*) AS BIGINT) n_f, round(sum(sqrt(nx*nx+ny*ny+nz*nz))/2,6)+0.0 area FROM fv")
def soup_to_indexed(spark, d):
    m = X.grid(spark, d)
    s = topology.summary(meshes.soup(meshes.corners(m.vertices, m.faces)))
    return s.select("n_v", "n_f", r("area").alias("area"))


@query(CLOUD + """ SELECT mesh_id, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY vid)-1 AS BIGINT) vid, round(x,6)+0.0 x, round(y,6)+0.0 y, round(z,6)+0.0 z FROM p WHERE vid % 3 = 0""")
def cloud_of_subset(spark, d):
    p = X.points(spark, d)
    return meshes.vertex_subset(MeshFrame(p, spark.createDataFrame([], "mesh_id bigint, fid bigint, v0 bigint, v1 bigint, v2 bigint")), p.where("vid % 3 = 0")).select("mesh_id", "vid", *xyz())


@query("""WITH g AS (SELECT CAST(a.range AS INT) i, CAST(b.range AS INT) j FROM range(6) a, range(8) b), t AS (SELECT i, j, (j-4.0)*(4.0/8)+1 x, (i-3.0)*(3.0/6)+2 y FROM g)
 SELECT i, j, round(x,6)+0.0 x, round(y,6)+0.0 y, round(x*x-y,6)+0.0 z, round(j/8.0,6)+0.0 u, round(i/6.0,6)+0.0 v FROM t""")
def function_map(spark, d):
    g = meshes.function_grid(spark, 6, 8, lambda x, y: x * x - y, (1.0, 2.0), (4.0, 3.0))
    return g.join(meshes.texture_grid(g, 6, 8), ["i", "j"]).select("i", "j", *xyz(), r("u").alias("u"), r("v").alias("v"))


@query(GRID + " SELECT v0, v1, v2, concat(v0, ' ', v1, ' ', v2) AS line FROM f")
def face_text_round_trip(spark, d):
    text = meshes.faces_to_text(X.grid(spark, d).faces)
    return meshes.faces_from_text(text.withColumn("line", F.col("value"))).select("v0", "v1", "v2", F.concat_ws(" ", "v0", "v1", "v2").alias("line"))


@query(GRID + CORNERS + " SELECT vid, " + rr("x", "y", "z", "nx", "ny", "nz") + " FROM (SELECT * FROM (" + "SELECT v.vid, v.x, v.y, v.z, sx/sqrt(sx*sx+sy*sy+sz*sz) nx, sy/sqrt(sx*sx+sy*sy+sz*sz) ny, sz/sqrt(sx*sx+sy*sy+sz*sz) nz FROM v JOIN (SELECT vid, sum(nx) sx, sum(ny) sy, sum(nz) sz FROM (SELECT unnest([v0,v1,v2]) vid, nx, ny, nz FROM fv) q GROUP BY vid) s USING (vid)) t) t")
def feature_matrix(spark, d):
    return measure.vertex_normals(X.grid(spark, d)).select("vid", *xyz(), *xyz("n"))


@query(PERFORATED + " SELECT CAST(row_number() OVER (ORDER BY vid)-1 AS BIGINT) vid, round(x,6)+0.0 x, round(y,6)+0.0 y, round(z,6)+0.0 z FROM v")
def repacked_ids(spark, d):
    return meshes.repacked(X.perforated(spark, d)).vertices.select("vid", *xyz())


@query(PERFORATED + ", n AS (SELECT vid, row_number() OVER (ORDER BY vid)-1 k FROM v) SELECT CAST(row_number() OVER (ORDER BY fid)-1 AS BIGINT) fid, CAST(a.k AS BIGINT) v0, CAST(b.k AS BIGINT) v1, CAST(c.k AS BIGINT) v2 FROM f JOIN n a ON a.vid=v0 JOIN n b ON b.vid=v1 JOIN n c ON c.vid=v2")
def repacked_faces(spark, d):
    return meshes.repacked(X.perforated(spark, d)).faces.select("fid", "v0", "v1", "v2")


@query(GRID + CORNERS + ", t AS (SELECT x, y, z FROM v UNION SELECT x+24, y, z FROM v WHERE false) SELECT CAST(2*count(*) AS BIGINT) n_v, CAST(2*(SELECT count(*) FROM f) AS BIGINT) n_f FROM v")
def mesh_union(spark, d):
    m = X.grid(spark, d)
    far = m.with_(vertices=edit.transformed(m.vertices, [1, 0, 0, 100, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]))
    return topology.summary(meshes.union(meshes.union(m, far), m)).select("n_v", "n_f")


@query(GRID + " SELECT fid, v0, v1, v2 FROM f WHERE (v0//1000)%5<3 AND (v1//1000)%5<3 AND (v2//1000)%5<3")
def subset_by_vertices(spark, d):
    m = X.grid(spark, d)
    return meshes.vertex_face_subset(m, m.vertices.where("(vid div 1000) % 5 < 3")).faces.select("fid", "v0", "v1", "v2")


@query(GRID + """, h1 AS (SELECT DISTINCT fid FROM fe WHERE a IN (5025)), n1 AS (SELECT DISTINCT a vid FROM fe WHERE fid IN (SELECT fid FROM h1)), h2 AS (SELECT DISTINCT fid FROM fe WHERE a IN (SELECT vid FROM n1))
 SELECT fid, v0, v1, v2 FROM f WHERE fid IN (SELECT fid FROM h2)""")
def subset_by_two_hops(spark, d):
    m = X.grid(spark, d)
    return meshes.vertex_face_subset(m, m.vertices.where("vid = 5025"), hops=2).faces.select("fid", "v0", "v1", "v2")


@query(GRID + " SELECT vid, round(x,6)+0.0 x, round(y,6)+0.0 y, round(z,6)+0.0 z FROM v WHERE vid IN (SELECT a FROM fe WHERE fid % 7 = 0)")
def subset_by_faces(spark, d):
    m = X.grid(spark, d)
    return meshes.face_subset(m, m.faces.where("fid % 7 = 0")).vertices.select("vid", *xyz())


# --- topology ------------------------------------------------------------------------

@query(GRID + " SELECT u, w, n AS nfaces FROM e")
def edge_table(spark, d):
    return topology.edges(X.grid(spark, d).faces).select("u", "w", "nfaces")


@query(GRID + " SELECT u, w, n AS nfaces, (SELECT min(fid) FROM fe WHERE fe.u=e.u AND fe.w=e.w) first, (SELECT max(fid) FROM fe WHERE fe.u=e.u AND fe.w=e.w) last FROM e")
def shared_faces(spark, d):
    s = topology.edge_faces(X.grid(spark, d).faces)
    return s.select("u", "w", "nfaces", F.array_min("fids").alias("first"), F.array_max("fids").alias("last"))


@query(GRID + " SELECT CAST(row_number() OVER (ORDER BY u, w)-1 AS BIGINT) eid, u, w FROM e")
def numbered_edges(spark, d):
    return topology.numbered_edges(X.grid(spark, d).faces).select(F.col("eid").cast("bigint").alias("eid"), "u", "w")


@query(PERFORATED + " SELECT u, w FROM e WHERE n=1")
def boundary_edges(spark, d):
    return topology.boundary_edges(X.perforated(spark, d).faces).select("u", "w")


@query(PERFORATED + " SELECT DISTINCT unnest([u,w]) vid FROM e WHERE n=1")
def boundary_vertices(spark, d):
    return topology.boundary_vertices(X.perforated(spark, d).faces).select("vid")


def _finned(spark, d) -> MeshFrame:
    """The grid with a fin of one face on the first edge of every tenth face."""
    m = X.grid(spark, d)
    f = m.faces.where("fid % 10 = 0")
    p = m.vertices.select("mesh_id", F.col("vid").alias("v0"), "x", "y", "z").join(f.select("mesh_id", "fid", "v0"), ["mesh_id", "v0"])
    v = p.select("mesh_id", (F.col("fid") + 2_000_000).alias("vid"), "x", "y", (F.col("z") + 500).alias("z"))
    fins = f.select("mesh_id", (F.col("fid") + 1_000_000).alias("fid"), "v0", "v1", (F.col("fid") + 2_000_000).alias("v2"))
    return m.with_(vertices=m.vertices.unionByName(v), faces=m.faces.unionByName(fins))


_FINS = GRID + """, g AS (SELECT u, w FROM fe UNION ALL SELECT least(v0,v1), greatest(v0,v1) FROM f WHERE fid%10=0 UNION ALL SELECT v0, fid+2000000 FROM f WHERE fid%10=0 UNION ALL SELECT v1, fid+2000000 FROM f WHERE fid%10=0),
 gn AS (SELECT u, w, CAST(count(*) AS BIGINT) nfaces FROM g GROUP BY u, w)"""


@query(_FINS + " SELECT u, w, nfaces FROM gn WHERE nfaces <> 2")
def irregular_edges(spark, d):
    return topology.irregular_edges(_finned(spark, d).faces).select("u", "w", "nfaces")


@query(GRID + " SELECT p.u, p.w, p.fid f, q.fid g, p.a <> q.a AS same FROM fe p JOIN fe q ON p.u=q.u AND p.w=q.w AND p.fid<>q.fid")
def dual_graph(spark, d):
    return topology.dual_edges(X.grid(spark, d).faces).select("u", "w", "f", "g", "same")


@query(GRID + " SELECT p.fid f, q.fid g, p.u, p.w FROM fe p JOIN fe q ON p.u=q.u AND p.w=q.w AND p.fid<q.fid")
def common_edges(spark, d):
    return topology.common_edges(X.grid(spark, d).faces).select("f", "g", "u", "w")


@query(GRID + " SELECT p.fid, p.u, p.w, q.fid AS other FROM fe p LEFT JOIN fe q ON p.u=q.u AND p.w=q.w AND p.fid<>q.fid")
def opposite_faces(spark, d):
    return topology.opposite_face(X.grid(spark, d).faces).select("fid", "u", "w", "other")


@query(GRID + " SELECT u, w FROM fe WHERE fid % 3 = 0 GROUP BY u, w HAVING count(*)=1")
def pseudo_boundary_of_subset(spark, d):
    m = X.grid(spark, d)
    return topology.pseudo_boundary(m.faces, m.faces.where("fid % 3 = 0")).select("u", "w")


@query(GRID + """, nb AS (SELECT u vid, w nbr FROM e UNION ALL SELECT w, u FROM e)
 SELECT vid, CAST(count(*) AS BIGINT) n_neighbours, CAST(sum(nbr) AS BIGINT) sum_neighbours, CAST((SELECT count(*) FROM fe WHERE a=vid) AS BIGINT) n_faces, count(*) > (SELECT count(*) FROM fe WHERE a=vid) open_ring FROM nb GROUP BY vid""")
def vertex_degree_one_ring(spark, d):
    return topology.vertex_degrees(X.grid(spark, d).faces).select("vid", "n_neighbours", "sum_neighbours", "n_faces", "open_ring")


@query(GRID + " SELECT fid, o AS vid, a AS n1, b AS n2 FROM fe")
def opposite_corners(spark, d):
    return topology.opposite_vertices(X.grid(spark, d).faces).select("fid", "vid", "n1", "n2")


@query(GRID + """, t AS (SELECT vid qid, vid a, vid-1 b, vid-1001 c FROM v WHERE vid % 4 = 0)
 SELECT qid, coalesce((SELECT fid FROM f WHERE least(v0,v1,v2)=least(a,b,c) AND greatest(v0,v1,v2)=greatest(a,b,c) AND v0+v1+v2=a+b+c), -1) fid FROM t""")
def find_faces(spark, d):
    m = X.grid(spark, d)
    t = m.vertices.where("vid % 4 = 0").select("mesh_id", F.col("vid").alias("qid"), (F.col("vid") - 1001).alias("v0"), F.col("vid").alias("v1"), (F.col("vid") - 1).alias("v2"))
    return topology.find_faces(m.faces, t).select("qid", "fid")


@query(GRID + " SELECT vid qid, coalesce((SELECT n FROM e WHERE u=vid-1 AND w=vid), 0) nfaces FROM v")
def find_edges(spark, d):
    m = X.grid(spark, d)
    p = m.vertices.select("mesh_id", F.col("vid").alias("qid"), F.col("vid").alias("a"), (F.col("vid") - 1).alias("b"))
    return topology.find_edges(m.faces, p).select("qid", "nfaces")


@query(GRID + ", g AS (SELECT * FROM f WHERE v0//1000 > 4) SELECT CAST((SELECT count(*) FROM g) AS BIGINT) n_f, CAST((SELECT count(DISTINCT a) FROM fe WHERE fid IN (SELECT fid FROM g)) AS BIGINT) n_v")
def remove_faces_then_orphans(spark, d):
    m = X.grid(spark, d)
    return topology.summary(topology.remove_faces(m, m.faces.where("v0 div 1000 <= 4"), orphans=True)).select("n_f", "n_v")


@query(GRID + " SELECT fid, v0, v1, v2 FROM f WHERE fid NOT IN (SELECT fid FROM fe WHERE u % 10 = 0 AND w = u + 1)")
def remove_edges(spark, d):
    m = X.grid(spark, d)
    return topology.remove_edges(m, topology.edges(m.faces).where("u % 10 = 0 and w = u + 1")).faces.select("fid", "v0", "v1", "v2")


@query(GRID + " SELECT vid FROM v WHERE NOT (vid % 2 = 0 AND vid NOT IN (SELECT a FROM fe WHERE fid % 5 = 0))")
def remove_free_vertices(spark, d):
    m = X.grid(spark, d)
    m = m.with_(faces=m.faces.where("fid % 5 = 0"))
    return topology.remove_vertices(m, m.vertices.where("vid % 2 = 0")).vertices.select("vid")


@query(GRID + " SELECT DISTINCT a AS vid FROM fe WHERE fid % 5 = 0")
def remove_disconnected_vertices(spark, d):
    m = X.grid(spark, d)
    return topology.remove_disconnected(m.with_(faces=m.faces.where("fid % 5 = 0"))).vertices.select("vid")


@query(GRID + """, nb AS (SELECT u vid, w nbr FROM e UNION ALL SELECT w, u FROM e), pr AS (SELECT vid-1000 a, vid-1 b FROM v WHERE vid-1000 IN (SELECT vid FROM v) AND vid-1 IN (SELECT vid FROM v) AND vid % 2 = 0),
 s AS (SELECT a, b, p.nbr s FROM pr JOIN nb p ON p.vid=a JOIN nb q ON q.vid=b AND q.nbr=p.nbr), t AS (SELECT v0 p, v1 q, v2 r FROM f UNION ALL SELECT s, a, b FROM s)
 SELECT DISTINCT least(p,q,r) a, p+q+r-least(p,q,r)-greatest(p,q,r) b, greatest(p,q,r) c FROM t""")
def common_neighbour_closure(spark, d):
    m = X.grid(spark, d)
    v = m.vertices.select("mesh_id", "vid")
    has = lambda k, n: v.select("mesh_id", (F.col("vid") + k).alias("vid"), F.col("vid").alias(n))
    pairs = v.where("vid % 2 = 0").join(has(1000, "a"), ["mesh_id", "vid"]).join(has(1, "b"), ["mesh_id", "vid"])
    key = F.array_sort(F.array("v0", "v1", "v2"))
    return topology.add_edges(m, pairs).faces.select(*[key[k].alias(n) for k, n in enumerate("abc")])


@query(GRID + " SELECT p.u x, p.w y, q.w z FROM e p JOIN e q ON q.u=p.w JOIN e t ON t.u=p.u AND t.w=q.w")
def triangle_enumeration(spark, d):
    e = topology.edges(X.grid(spark, d).faces)
    return topology.triangles_of(e.select(F.col("u").alias("x"), F.col("w").alias("y"))).select("x", "y", "z")


@query(GRID + """ SELECT p.fid f, q.fid g, (CASE WHEN p.v0 IN (q.v0,q.v1,q.v2) THEN 1 ELSE 0 END + CASE WHEN p.v1 IN (q.v0,q.v1,q.v2) THEN 1 ELSE 0 END + CASE WHEN p.v2 IN (q.v0,q.v1,q.v2) THEN 1 ELSE 0 END) = 2 adjacent, p.fid=q.fid AS same FROM f p JOIN f q ON q.v0 = p.v0""")
def face_adjacency(spark, d):
    f = X.grid(spark, d).faces
    a = f.select("v0", F.col("fid").alias("f"), F.array("v0", "v1", "v2").alias("a"))
    b = f.select("v0", F.col("fid").alias("g"), F.array("v0", "v1", "v2").alias("b"))
    return topology.adjacent(a.join(b, "v0")).select("f", "g", "adjacent", "same")


# --- measures ------------------------------------------------------------------------

@query(GRID + CORNERS + " SELECT fid, " + rr("nx", "ny", "nz") + ", round(sqrt(nx*nx+ny*ny+nz*nz)/2,6)+0.0 area, round(nz/sqrt(nx*nx+ny*ny+nz*nz),6)+0.0 uz FROM fv")
def face_geometry(spark, d):
    return measure.face_geometry(X.grid(spark, d)).select("fid", *[r(f"n.{a}").alias(f"n{a}") for a in "xyz"], r("area").alias("area"), r("unit.z").alias("uz"))


@query(GRID + CORNERS + """, t AS (SELECT fid, v0 vid, x1-x0 ax, y1-y0 ay, z1-z0 az, x2-x0 bx, y2-y0 by_, z2-z0 bz FROM k UNION ALL SELECT fid, v1, x2-x1, y2-y1, z2-z1, x0-x1, y0-y1, z0-z1 FROM k UNION ALL SELECT fid, v2, x0-x2, y0-y2, z0-z2, x1-x2, y1-y2, z1-z2 FROM k)
 SELECT fid, vid, round(acos(greatest(-1, least(1, (ax*bx+ay*by_+az*bz)/(sqrt(ax*ax+ay*ay+az*az)*sqrt(bx*bx+by_*by_+bz*bz))))), 6) angle FROM t""")
def inner_angles(spark, d):
    return measure.inner_angles(X.grid(spark, d)).select("fid", "vid", r("angle").alias("angle"))


_M = [2.0, 0.0, 0.0, 1.0, 0.0, 0.0, -1.0, 2.0, 0.0, 1.0, 0.0, 3.0, 0.0, 0.0, 0.0, 1.0]


@query(CLOUD + """, t AS (SELECT mesh_id, 2*x+1 x, -z+2 y, y+3 z FROM p), b AS (SELECT mesh_id, min(x) min_x, max(x) max_x, min(y) min_y, max(y) max_y, min(z) min_z, max(z) max_z FROM t GROUP BY mesh_id)
 SELECT mesh_id, """ + rr("min_x", "max_x", "min_y", "max_y", "min_z", "max_z") + ", round((min_x+max_x)/2,6)+0.0 mid_x, round(sqrt((max_x-min_x)^2+(max_y-min_y)^2+(max_z-min_z)^2),6)+0.0 diagonal FROM b")
def affine_transform_bounds(spark, d):
    b = measure.box_metrics(measure.bounds(edit.transformed(X.points(spark, d), _M)))
    return b.select("mesh_id", *[r(f"{m}_{a}").alias(f"{m}_{a}") for a in "xyz" for m in ("min", "max")], r("mid_x").alias("mid_x"), r("diagonal").alias("diagonal"))


@query(CLOUD + ", b AS (SELECT mesh_id id, min(x) ax, max(x) bx, min(y) ay, max(y) by_, min(z) az, max(z) bz FROM p GROUP BY mesh_id) SELECT s.id a, t.id b FROM b s JOIN b t ON s.id<t.id AND s.ax<=t.bx AND t.ax<=s.bx AND s.ay<=t.by_ AND t.ay<=s.by_ AND s.az<=t.bz AND t.az<=s.bz")
def overlapping_boxes(spark, d):
    b = measure.bounds(X.points(spark, d)).withColumnRenamed("mesh_id", "id")
    return spatial.overlapping_boxes(b)


@query(CLOUD + " SELECT " + ", ".join(f"round({m}({a}),6)+0.0 AS {m}_{a}" for a in "xyz" for m in ("min", "max")) + " FROM p")
def bounds_union(spark, d):
    b = measure.box_union(measure.bounds(X.points(spark, d)))
    return b.select(*[r(f"{m}_{a}").alias(f"{m}_{a}") for a in "xyz" for m in ("min", "max")])


@query(CLOUD + " SELECT mesh_id, CAST(count(*) AS BIGINT) n, " + ", ".join(f"round(covar_pop({a},{b}),6)+0.0 AS c_{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM p GROUP BY mesh_id")
def pca_covariance(spark, d):
    return measure.covariance(X.points(spark, d)).select("mesh_id", "n", *[r(f"c_{k}").alias(f"c_{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz")])


_CURVED = NORMALS + """, fa AS (SELECT fid, v0, v1, v2, sqrt(nx*nx+ny*ny+nz*nz)/2 area FROM fv), se AS (SELECT u, w, sum(area) s_e FROM fe JOIN fa USING (fid) GROUP BY u, w), sv AS (SELECT vid, sum(area) s_v FROM (SELECT unnest([v0,v1,v2]) vid, area FROM fa) q GROUP BY vid),
 dr AS (SELECT u vid, w nbr, s_e FROM se UNION ALL SELECT w, u, s_e FROM se),
 r0 AS (SELECT d.vid, s_e/s_v wt, nx, ny, nz, q.x-n.x dx, q.y-n.y dy, q.z-n.z dz FROM dr d JOIN vn n ON n.vid=d.vid JOIN sv s ON s.vid=d.vid JOIN v q ON q.vid=d.nbr),
 r1 AS (SELECT vid, wt, nx, ny, nz, dx/sqrt(dx*dx+dy*dy+dz*dz) ux, dy/sqrt(dx*dx+dy*dy+dz*dz) uy, dz/sqrt(dx*dx+dy*dy+dz*dz) uz FROM r0),
 r2 AS (SELECT *, nx*ux+ny*uy+nz*uz nu FROM r1), r3 AS (SELECT *, nx*nu-ux px, ny*nu-uy py, nz*nu-uz pz FROM r2),
 r4 AS (SELECT vid, wt*2*nu k, px/sqrt(px*px+py*py+pz*pz) tx, py/sqrt(px*px+py*py+pz*pz) ty, pz/sqrt(px*px+py*py+pz*pz) tz FROM r3),
 mm AS (SELECT vid, sum(k*tx*tx) xx, sum(k*tx*ty) xy, sum(k*tx*tz) xz, sum(k*ty*ty) yy, sum(k*ty*tz) yz, sum(k*tz*tz) zz FROM r4 GROUP BY vid),
 h0 AS (SELECT mm.*, nx, ny, nz, CASE WHEN (1-nx)*(1-nx)+ny*ny+nz*nz > (1+nx)*(1+nx)+ny*ny+nz*nz THEN -1.0 ELSE 1.0 END sg FROM mm JOIN vn USING (vid)),
 h1 AS (SELECT *, 1+sg*nx ax, sg*ny ay, sg*nz az FROM h0), h2 AS (SELECT *, ax/sqrt(ax*ax+ay*ay+az*az) wx, ay/sqrt(ax*ax+ay*ay+az*az) wy, az/sqrt(ax*ax+ay*ay+az*az) wz FROM h1),
 h3 AS (SELECT *, -2*wx*wy q2x, 1-2*wy*wy q2y, -2*wz*wy q2z, -2*wx*wz q3x, -2*wy*wz q3y, 1-2*wz*wz q3z FROM h2),
 h4 AS (SELECT vid, nx, ny, nz, xx*q2x*q2x+yy*q2y*q2y+zz*q2z*q2z+2*(xy*q2x*q2y+xz*q2x*q2z+yz*q2y*q2z) ca, xx*q3x*q3x+yy*q3y*q3y+zz*q3z*q3z+2*(xy*q3x*q3y+xz*q3x*q3z+yz*q3y*q3z) cb FROM h3),
 cu AS (SELECT vid, nx, ny, nz, 3*ca-cb kp1, 3*cb-ca kp2 FROM h4)"""


@query(GRID + CORNERS + _CURVED + " SELECT vid, " + rr("kp1", "kp2") + " FROM cu")
def curvature(spark, d):
    return measure.curvature(X.grid(spark, d)).select("vid", r("kp1").alias("kp1"), r("kp2").alias("kp2"))


@query(GRID + CORNERS + _CURVED + " SELECT fid, round(avg(kp1),6)+0.0 kp1, round(avg(kp2),6)+0.0 kp2 FROM fe JOIN cu ON cu.vid=a GROUP BY fid")
def curvature_metrics(spark, d):
    m = X.grid(spark, d)
    return measure.curvature_metrics(m, measure.curvature(m))[0].select("fid", r("kp1").alias("kp1"), r("kp2").alias("kp2"))


@query(GRID + CORNERS + _CURVED + """, nb AS (SELECT u vid, w nbr FROM e UNION ALL SELECT w, u FROM e), hi AS (SELECT vid FROM cu WHERE (abs(kp1)+abs(kp2))/2 > 1.0),
 mv AS (SELECT nb.vid, avg(q.x) x, avg(q.y) y, avg(q.z) z FROM nb JOIN hi USING (vid) JOIN v q ON q.vid=nbr GROUP BY nb.vid)
 SELECT v.vid, round(coalesce(mv.x, v.x),6)+0.0 x, round(coalesce(mv.y, v.y),6)+0.0 y, round(coalesce(mv.z, v.z),6)+0.0 z, mv.x IS NOT NULL moved FROM v LEFT JOIN mv USING (vid)""")
def jacobi_smooth_round(spark, d):
    return measure.smooth_round(X.grid(spark, d), 1.0).select("vid", *xyz(), "moved")


@query(GRID + CORNERS + """, s AS (SELECT fid, nx/sqrt(nx*nx+ny*ny+nz*nz) ux, ny/sqrt(nx*nx+ny*ny+nz*nz) uy, nz/sqrt(nx*nx+ny*ny+nz*nz) uz, (x0+x1+x2)/3 cx, (y0+y1+y2)/3 cy, (z0+z1+z2)/3 cz FROM fv),
 m AS (SELECT avg(ux) mx, avg(uy) my, avg(uz) mz, avg(cx) px, avg(cy) py, avg(cz) pz FROM s), o AS (SELECT s.*, (mx-ux)^2+(my-uy)^2+(mz-uz)^2 off, (cx-px)*mx+(cy-py)*my+(cz-pz)*mz ahead FROM s, m)
 SELECT fid FROM o WHERE off <= 4*(SELECT avg(off) FROM o) AND ahead > 0""")
def front_finder_round(spark, d):
    return measure.front_round(measure.front_state(X.grid(spark, d))).select("fid")


# --- spatial -------------------------------------------------------------------------

@query(CLOUD + ", h AS (SELECT a.vid qid, b.vid vid, (a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2 d2 FROM p a, p b WHERE a.vid % 7 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, vid) k FROM h) SELECT qid, CAST(k AS INT) k, vid, round(d2,6)+0.0 d2 FROM k WHERE k <= 5")
def knn_vertices(spark, d):
    p = X.points(spark, d)
    return spatial.nearest(p.where("vid % 7 = 0").withColumnRenamed("vid", "qid"), p, 5).select("qid", "k", "vid", r("d2").alias("d2"))


@query(CLOUD + PROBES + ", g AS (SELECT vid*100 vid, x*40+25 x, y*8+5 y, z*20+50 z FROM p WHERE vid >= 40), h AS (SELECT qid, vid, (x-qx)^2+(y-qy)^2+(z-qz)^2 d2 FROM q, g), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, vid) k FROM h) SELECT qid, vid, round(d2,6)+0.0 d2 FROM k WHERE k = 1")
def nearest_vertex(spark, d):
    p = X.points(spark, d).where("vid >= 40").select((F.col("vid") * 100).alias("vid"), (F.col("x") * 40 + 25).alias("x"), (F.col("y") * 8 + 5).alias("y"), (F.col("z") * 20 + 50).alias("z"))
    return spatial.nearest(X.probes(spark, d), p).select("qid", "vid", r("d2").alias("d2"))


@query(CLOUD + " SELECT a.vid qid, b.vid, round((a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2,6)+0.0 d2 FROM p a, p b WHERE (a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2 < 0.004")
def radius_join(spark, d):
    p = X.points(spark, d)
    return spatial.radius_join(p.withColumnRenamed("vid", "qid"), p, 0.004).select("qid", "vid", r("d2").alias("d2"))


_SEG = "greatest(0.0, least(1.0, ((qx-{a0})*({b0}-{a0})+(qy-{a1})*({b1}-{a1})+(qz-{a2})*({b2}-{a2}))/(({b0}-{a0})^2+({b1}-{a1})^2+({b2}-{a2})^2)))"


def _segment(s: int, t: int) -> str:
    return _SEG.format(**{f"a{i}": f"{a}{s}" for i, a in enumerate("xyz")}, **{f"b{i}": f"{a}{t}" for i, a in enumerate("xyz")})


@query("WITH " + _grid() + CORNERS + ", " + CLOUD[5:] + PROBES + f""", j AS (SELECT q.*, fv.*, {_segment(0, 1)} t0, {_segment(1, 2)} t1, {_segment(2, 0)} t2, ((qx-x0)*nx+(qy-y0)*ny+(qz-z0)*nz)/(nx*nx+ny*ny+nz*nz) h FROM q, fv),
 c AS (SELECT qid, fid, (((y2-y1)*(qz-z1)-(z2-z1)*(qy-y1))*nx+((z2-z1)*(qx-x1)-(x2-x1)*(qz-z1))*ny+((x2-x1)*(qy-y1)-(y2-y1)*(qx-x1))*nz) b0, (((y0-y2)*(qz-z2)-(z0-z2)*(qy-y2))*nx+((z0-z2)*(qx-x2)-(x0-x2)*(qz-z2))*ny+((x0-x2)*(qy-y2)-(y0-y2)*(qx-x2))*nz) b1, (((y1-y0)*(qz-z0)-(z1-z0)*(qy-y0))*nx+((z1-z0)*(qx-x0)-(x1-x0)*(qz-z0))*ny+((x1-x0)*(qy-y0)-(y1-y0)*(qx-x0))*nz) b2,
  h*h*(nx*nx+ny*ny+nz*nz) dp, (x0+t0*(x1-x0)-qx)^2+(y0+t0*(y1-y0)-qy)^2+(z0+t0*(z1-z0)-qz)^2 d0, (x1+t1*(x2-x1)-qx)^2+(y1+t1*(y2-y1)-qy)^2+(z1+t1*(z2-z1)-qz)^2 d1, (x2+t2*(x0-x2)-qx)^2+(y2+t2*(y0-y2)-qy)^2+(z2+t2*(z0-z2)-qz)^2 d2 FROM j)
 SELECT qid, round(min(CASE WHEN b0>=0 AND b1>=0 AND b2>=0 THEN dp ELSE least(d0,d1,d2) END),6)+0.0 d2 FROM c GROUP BY qid""")
def closest_surface_point(spark, d):
    return spatial.closest_surface_point(X.probes(spark, d), X.grid(spark, d)).select("qid", r("d2").alias("d2"))


@query("WITH " + _grid() + CORNERS + ", " + CLOUD[5:] + PROBES + """, j AS (SELECT qid, fid, x0, y0, z0, nx, ny, nz, x1, y1, x2, y2, qx, qy, z0 + ((x0-qx)*nx+(y0-qy)*ny)/nz hz, (x1-x0)*(qy-y0)-(y1-y0)*(qx-x0) s0, (x2-x1)*(qy-y1)-(y2-y1)*(qx-x1) s1, (x0-x2)*(qy-y2)-(y0-y2)*(qx-x2) s2 FROM q, fv WHERE nz <> 0),
 h AS (SELECT qid, hz + 0.0 t, hz FROM j WHERE (s0>=0 AND s1>=0 AND s2>=0) OR (s0<=0 AND s1<=0 AND s2<=0)) SELECT qid, round(min(t),6)+0.0 t, round(min(hz),6)+0.0 z FROM h GROUP BY qid""")
def ray_cast(spark, d):
    rays = X.probes(spark, d).withColumn("z", F.lit(0.0)).select("qid", "x", "y", "z", F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(1.0).alias("uz"))
    return spatial.ray_cast(rays, X.grid(spark, d)).select("qid", r("t").alias("t"), r("z").alias("z"))


# --- editing -------------------------------------------------------------------------

@query(GRID + CORNERS + ", b AS (SELECT *, (fid%7+1)/16.0 b0, (fid%5+1)/16.0 b1 FROM k), w AS (SELECT *, 1-b0-b1 b2 FROM b) SELECT fid qid, CAST(b0 AS DOUBLE) b0, CAST(b1 AS DOUBLE) b1, CAST(b2 AS DOUBLE) b2, round(b0*x0+b1*x1+b2*x2,6)+0.0 x, round(b0*y0+b1*y1+b2*y2,6)+0.0 y, round(b0*z0+b1*z1+b2*z2,6)+0.0 z FROM w")
def barycentric_roundtrip(spark, d):
    m = X.grid(spark, d)
    u, v = ((F.col("fid") % k + 1) / 16 for k in (7, 5))
    a, b, c = meshes.corner_vecs()
    p = meshes.corners(m.vertices, m.faces).select("mesh_id", "fid", F.col("fid").alias("qid"), *(a * u + b * v + c * (1 - u - v)).columns())
    return edit.barycentric_round_trip(m, p).select("qid", *[r(f"b{k}").alias(f"b{k}") for k in range(3)], *xyz())


def _textured(spark, d) -> MeshFrame:
    m = X.grid(spark, d)
    v = m.vertices.select("mesh_id", F.lit(0).cast("bigint").alias("mid"), F.col("vid").alias("uvid"), (F.col("x") / 50).alias("u"), (F.col("y") / 10).alias("v"))
    f = m.faces.select("mesh_id", F.lit(0).cast("bigint").alias("mid"), "fid", F.col("v0").alias("uv0"), F.col("v1").alias("uv1"), F.col("v2").alias("uv2"))
    return m.with_(uvs=v, face_uvs=f.where("fid % 5 <> 0"))


@query(GRID + CORNERS + " SELECT fid, CASE WHEN fid%5=0 THEN -1.0 ELSE round((x0+x1+x2)/150,6)+0.0 END u, CASE WHEN fid%5=0 THEN -1.0 ELSE round((y0+y1+y2)/30,6)+0.0 END v FROM k")
def uv_interpolation(spark, d):
    m = _textured(spark, d)
    a, b, c = meshes.corner_vecs()
    p = meshes.corners(m.vertices, m.faces).select("mesh_id", "fid", F.col("fid").alias("qid"), *((a + b + c) * (1 / 3)).columns())
    return edit.texture_points(m, p).select("fid", r("u").alias("u"), r("v").alias("v"))


@query(GRID + " SELECT fid, CASE WHEN fid%5=0 THEN -1 ELSE 0 END AS mid FROM f")
def face_material_ids(spark, d):
    m = _textured(spark, d)
    return texture.face_materials(m.faces, m.face_uvs).select("fid", F.col("mid").cast("int").alias("mid"))


_PLANE = ((25.3, 5.2, 50.0), (1.0, 0.5, 0.0))


@query(GRID + CORNERS + """, s AS (SELECT fid, CASE WHEN (x0-25.3)+0.5*(y0-5.2)>=0 THEN 1 ELSE 0 END + CASE WHEN (x1-25.3)+0.5*(y1-5.2)>=0 THEN 1 ELSE 0 END + CASE WHEN (x2-25.3)+0.5*(y2-5.2)>=0 THEN 1 ELSE 0 END n FROM k)
 SELECT fid, CAST(CASE n WHEN 3 THEN 1 WHEN 0 THEN -1 ELSE 0 END AS INT) half, CAST(n AS INT) n_in FROM s""")
def plane_classify(spark, d):
    return edit.facet_cuts(X.grid(spark, d), *_PLANE).select("fid", "half", "n_in")


@query(GRID + CORNERS + """, g AS (SELECT fid, sqrt(nx*nx+ny*ny+nz*nz)/2 area, (x0-25.3)+0.5*(y0-5.2) d0, (x1-25.3)+0.5*(y1-5.2) d1, (x2-25.3)+0.5*(y2-5.2) d2 FROM fv),
 n AS (SELECT *, CASE WHEN d0>=0 THEN 1 ELSE 0 END + CASE WHEN d1>=0 THEN 1 ELSE 0 END + CASE WHEN d2>=0 THEN 1 ELSE 0 END n FROM g),
 l AS (SELECT *, CASE WHEN n=1 THEN CASE WHEN d0>=0 THEN 0 WHEN d1>=0 THEN 1 ELSE 2 END WHEN n=2 THEN CASE WHEN d0<0 THEN 0 WHEN d1<0 THEN 1 ELSE 2 END END k FROM n),
 c AS (SELECT fid, area, n, CASE k WHEN 0 THEN (d0/(d0-d1))*(d0/(d0-d2)) WHEN 1 THEN (d1/(d1-d2))*(d1/(d1-d0)) WHEN 2 THEN (d2/(d2-d0))*(d2/(d2-d1)) END s FROM l)
 SELECT fid src, round(CASE n WHEN 3 THEN area WHEN 1 THEN area*s ELSE area*(1-s) END,6)+0.0 area, CAST(CASE n WHEN 2 THEN 2 ELSE 1 END AS BIGINT) n FROM c WHERE n > 0""")
def plane_slice(spark, d):
    s = edit.slice_soup(X.grid(spark, d), *_PLANE)
    return s.groupBy("src").agg((r(F.sum(vec.area(*meshes.corner_vecs())))).alias("area"), F.count("*").alias("n"))


@query(GRID + CORNERS + " SELECT fid, v2 v0, v1, v0 v2, round(20-x0,6)+0.0 x FROM k")
def reflect(spark, d):
    m = edit.reflected(X.grid(spark, d), (10.0, 0.0, 0.0), (2.0, 0.0, 0.0))
    return meshes.corners(m.vertices, m.faces).select("fid", "v0", "v1", "v2", r("x2").alias("x"))


@query(GRID + CORNERS + " SELECT CAST(t.fid*3+t.k AS BIGINT) fid, round(area/3,6)+0.0 area FROM (SELECT fid, unnest([0,1,2]) k, sqrt(nx*nx+ny*ny+nz*nz)/2 area FROM fv) t")
def centroid_subdivide(spark, d):
    return measure.face_geometry(edit.subdivided(X.grid(spark, d))).select("fid", r("area").alias("area"))


@query(GRID + CORNERS + " SELECT fid*4+k fid, round(area/4,6)+0.0 area FROM (SELECT fid, unnest([0,1,2,3]) k, sqrt(nx*nx+ny*ny+nz*nz)/2 area FROM fv) t")
def midpoint_subdivide(spark, d):
    return measure.face_geometry(edit.split_midpoints(X.grid(spark, d))).select("fid", r("area").alias("area"))


@query(GRID + ", g AS (SELECT vid d, vid-1001 a, vid-1 b, vid-1000 c FROM v WHERE vid IN (SELECT v0 FROM f)) SELECT least(d,b,c) p, greatest(d,b,c) q FROM g UNION ALL SELECT least(a,b,c), greatest(a,b,c) FROM g")
def edge_flip_independent(spark, d):
    m = X.grid(spark, d)
    f = edit.flipped(m.faces, topology.edges(m.faces).where("w - u = 1001"))
    return f.select(F.least("v0", "v1", "v2").alias("p"), F.greatest("v0", "v1", "v2").alias("q"))


@query(GRID + " SELECT least(v0,v1,v2) a, v0+v1+v2-least(v0,v1,v2)-greatest(v0,v1,v2) b, greatest(v0,v1,v2) c FROM f")
def tetra_removal(spark, d):
    key = F.array_sort(F.array("v0", "v1", "v2"))
    m = X.grid(spark, d)
    fine = edit.subdivided(m)
    out = edit.without_tetrahedra(fine)
    return out.faces.select(*[key[k].alias(n) for k, n in enumerate("abc")])


@query(GRID + " SELECT vid, round(CASE vid%3 WHEN 0 THEN 2*x ELSE x END,6)+0.0 x, round(CASE vid%3 WHEN 0 THEN 2*y ELSE y END,6)+0.0 y, round(CASE vid%3 WHEN 0 THEN 2*z ELSE z END,6)+0.0 z FROM v")
def scale_vertices(spark, d):
    v = X.grid(spark, d).vertices
    return edit.scale(v, v.where("vid % 3 = 0").select("mesh_id", "vid", F.lit(2.0).alias("s"))).select("vid", *xyz())


@query(GRID + " SELECT CASE WHEN j IN (1,2) THEN vid+3-2*j ELSE vid END vid, " + rr("x", "y", "z") + " FROM v")
def swap_vertices(spark, d):
    v = X.grid(spark, d).vertices
    return edit.swap(v, v.where("vid % 1000 = 1").select("mesh_id", F.col("vid").alias("a"), (F.col("vid") + 1).alias("b"))).select("vid", *xyz())


@query(GRID + " SELECT fid, CASE WHEN fid%2=0 THEN v2 ELSE v0 END v0, v1, CASE WHEN fid%2=0 THEN v0 ELSE v2 END v2 FROM f")
def reverse_faces(spark, d):
    f = X.grid(spark, d).faces
    return edit.reverse(f, f.where("fid % 2 = 0")).select("fid", "v0", "v1", "v2")


# --- texture -------------------------------------------------------------------------

@query("""WITH m AS (SELECT CAST(n_nationkey AS BIGINT) mid, 10+n_nationkey r, 20+3*n_nationkey c FROM nation), t AS (SELECT mid, CAST(floor(c*34.0/r) AS BIGINT) width FROM m)
 SELECT mid, width, CAST(coalesce(sum(width) OVER (ORDER BY mid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) start, CAST(sum(width) OVER () AS BIGINT) total FROM t""")
def atlas_offsets(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    m = n.select(F.lit(0).cast("bigint").alias("mesh_id"), F.col("n_nationkey").cast("bigint").alias("mid"), (10 + F.col("n_nationkey")).alias("rows"), (20 + 3 * F.col("n_nationkey")).alias("cols"))
    return texture.atlas(m).select("mid", "width", "start", "total")


@query(GRID + CORNERS + " SELECT CAST(count(DISTINCT (x, y)) AS BIGINT) n_uv, CAST((SELECT count(*) FROM f) AS BIGINT) n_f FROM v WHERE vid IN (SELECT a FROM fe)")
def uv_dedup(spark, d):
    m = X.grid(spark, d)
    c = meshes.corners(m.vertices, m.faces)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), (F.col(f"x{k}") / 50).alias("u"), (F.col(f"y{k}") / 10).alias("v")) for k in range(3)]))
    uv, f = texture.set_face_uvs(c.select("mesh_id", F.lit(0).alias("mid"), "fid", rows.alias("r")).select("mesh_id", "mid", "fid", "r.*"))
    return uv.agg(F.count("*").alias("n_uv")).join(f.agg(F.count("*").alias("n_f")))  # a row each


@query(GRID + ", t AS (SELECT u, w, CAST(count(DISTINCT fid % 2) AS BIGINT) n FROM fe GROUP BY u, w) SELECT * FROM t")
def texture_seams(spark, d):
    m = X.grid(spark, d)
    f = m.faces.select("mesh_id", (F.col("fid") % 2).alias("mid"), "fid", F.col("v0").alias("uv0"), F.col("v1").alias("uv1"), F.col("v2").alias("uv2"))
    return texture.texture_edges(m.faces, f).select("u", "w", "n")


@query("SELECT p_partkey AS mid, CAST(greatest(round(r*s),1) AS INT) AS rows, CAST(greatest(round(c*s),1) AS INT) AS cols FROM (SELECT p_partkey, 100+p_size*7 r, 60+p_size*11 c, least(1.0, 256.0/greatest(100+p_size*7, 60+p_size*11)) s FROM part) t")
def image_sizes(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("mid"), (100 + F.col("p_size") * 7).alias("rows"), (60 + F.col("p_size") * 11).alias("cols"))
    return texture.shrunken(p, 256).select("mid", "rows", "cols")


# --- frames --------------------------------------------------------------------------

_CAM = frames.Camera((25.0, 5.0, 200.0), (25.0, 5.0, 0.0), (0.0, 1.0, 0.0), 40.0)


@query(GRID + ", c AS (SELECT vid, x-25 dx, y-5 dy, 200-z dz FROM v) SELECT vid, round(dx*0.5/tan(radians(20.0))/dz+0.5,6)+0.0 px, round(0.5-dy*0.5/tan(radians(20.0))/dz,6)+0.0 py FROM c")
def camera_project(spark, d):
    x, y = _CAM.project(Vec.of())
    return X.grid(spark, d).vertices.select("vid", r(x).alias("px"), r(y).alias("py"))


@query(CLOUD + ", t AS (SELECT x, y, z, 2*x+1 tx, -z+2 ty, y+3 tz FROM p) SELECT CAST(count(*) AS DOUBLE) n, " + ", ".join(f"round(sum({s}*t{t}),6)+0.0 AS p{s}{t}" for s in "xyz" for t in "xyz") + " FROM t")
def procrustes_covariance(spark, d):
    p = X.points(spark, d)
    return frames.pair_sums(p, edit.transformed(p, _M)).select("n", *[r(f"p{a}{b}").alias(f"p{a}{b}") for a in "xyz" for b in "xyz"])


@query("SELECT vid, x, y, z FROM (" + CLOUD + " SELECT vid, round(2*x+1,5)+0.0 x, round(2*(-z)+2,5)+0.0 y, round(2*y+3,5)+0.0 z FROM p) t")
def procrustes_fit(spark, d):
    p = X.points(spark, d)
    t = edit.transformed(p, [2.0, 0, 0, 1.0, 0, 0, -2.0, 2.0, 0, 2.0, 0, 3.0, 0, 0, 0, 1])
    return frames.procrustes(p, t).apply(p).select("vid", *[r(a, 5).alias(a) for a in "xyz"])


@query(CLOUD + """, c AS (SELECT mesh_id, covar_pop(x,x) a, covar_pop(x,y) b, covar_pop(x,z) c, covar_pop(y,y) d, covar_pop(y,z) e, covar_pop(z,z) f FROM p GROUP BY mesh_id),
 q AS (SELECT *, (a+d+f)/3 q FROM c), s AS (SELECT *, sqrt(((a-q)^2+(d-q)^2+(f-q)^2+2*(b*b+c*c+e*e))/6) s FROM q),
 h AS (SELECT *, acos(greatest(-1, least(1, ((a-q)*((d-q)*(f-q)-e*e)-b*(b*(f-q)-e*c)+c*(b*e-(d-q)*c))/(2*s^3))))/3 h FROM s)
 SELECT mesh_id, round(q+2*s*cos(h),6)+0.0 v0, round(3*q-(q+2*s*cos(h))-(q+2*s*cos(h+2*pi()/3)),6)+0.0 v1, round(q+2*s*cos(h+2*pi()/3),6)+0.0 v2, CAST(0 AS DOUBLE) AS off, CAST(0 AS DOUBLE) AS skew FROM h""")
def principal_axes(spark, d):
    """Variances along the axes of each mesh; how far M v is from its value times v, and
    how far the axes are from right angles."""
    p = X.points(spark, d)
    a = measure.axes(p).join(measure.covariance(p).drop("n", "m_x", "m_y", "m_z"), "mesh_id")
    v = [Vec(*(F.get(F.col("vectors")[k], F.lit(i)) for i in range(3))) for k in range(3)]
    row = [Vec(*(F.col("c_" + "".join(sorted((s, t)))) for t in "xyz")) for s in "xyz"]
    off = F.greatest(*[F.abs(row[i].dot(v[k]) - F.col("values")[k] * list(v[k])[i]) for k in range(3) for i in range(3)])
    skew = F.greatest(*[F.abs(v[i].dot(v[k]) - float(i == k)) for i in range(3) for k in range(i, 3)])
    return a.select("mesh_id", *[r(F.col("values")[k]).alias(f"v{k}") for k in range(3)], r(off).alias("off"), r(skew).alias("skew"))


@query("SELECT vid, x, y, z FROM (" + CLOUD + " SELECT vid, round((mesh_id+1)*(-y)+mesh_id,5)+0.0 x, round((mesh_id+1)*x-2,5)+0.0 y, round((mesh_id+1)*z+mesh_id*mesh_id,5)+0.0 z FROM p) t")
def procrustes_fits(spark, d):
    """Each mesh is turned, scaled and moved in its own way, and fitted on its own."""
    p, m = X.points(spark, d), F.col("mesh_id")
    t = p.select("mesh_id", "vid", (-(m + 1) * F.col("y") + m).alias("x"), ((m + 1) * F.col("x") - 2).alias("y"), ((m + 1) * F.col("z") + m * m).alias("z"))
    return frames.fitted(p, frames.procrustes_each(p, t)).select("vid", *[r(a, 5).alias(a) for a in "xyz"])


# --- graph ---------------------------------------------------------------------------

_STEPS = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 pos, value x, CAST(event_id%7 AS DOUBLE) y, CAST(event_id%5 AS DOUBLE) z FROM events"


def _steps(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("path_id"), pos.cast("bigint").alias("pos"), F.col("value").alias("x"), (F.col("event_id") % 7).cast("double").alias("y"), (F.col("event_id") % 5).cast("double").alias("z"))


@query(f"WITH s AS ({_STEPS}), l AS (SELECT user_id, sqrt((x-lag(x) OVER w)^2+(y-lag(y) OVER w)^2+(z-lag(z) OVER w)^2) d FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)) SELECT user_id path_id, round(coalesce(sum(d),0),4)+0.0 length FROM l GROUP BY user_id")
def path_length(spark, d):
    return graph.path_lengths(_steps(spark, d)).select("path_id", r("length", 4).alias("length"))


@query(f"""WITH s AS ({_STEPS}), n AS (SELECT *, max(pos) OVER (PARTITION BY user_id) m, first_value(x) OVER w ax, first_value(y) OVER w ay, first_value(z) OVER w az, last_value(x) OVER w bx, last_value(y) OVER w by_, last_value(z) OVER w bz FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 k AS (SELECT user_id, pos, row_number() OVER (PARTITION BY user_id ORDER BY sqrt((x-ax)^2+(y-ay)^2+(z-az)^2)+sqrt((x-bx)^2+(y-by_)^2+(z-bz)^2) DESC, pos) k FROM n WHERE pos > 0 AND pos < m)
 SELECT user_id path_id, CAST(coalesce((SELECT pos FROM k WHERE k.user_id=u.user_id AND k=1), -1) AS BIGINT) pos FROM (SELECT DISTINCT user_id FROM s) u""")
def maximally_extruded(spark, d):
    return graph.most_extruded(_steps(spark, d)).select("path_id", "pos")


_REACH = ", dl AS (SELECT p.fid f, q.fid g FROM fe p JOIN fe q ON p.u=q.u AND p.w=q.w AND p.fid<>q.fid), re(f, root) AS (SELECT fid, fid FROM f WHERE fid IN (SELECT min(fid) FROM f WHERE v0%1000<24 UNION ALL SELECT min(fid) FROM f WHERE v0%1000>25) UNION SELECT dl.g, re.root FROM re JOIN dl ON dl.f=re.f)"


@query(RECURSIVE_STRIPS + _REACH + ", s AS (SELECT root, count(*) n, row_number() OVER (ORDER BY count(*) DESC, root)-1 m FROM re GROUP BY root) SELECT re.f fid, CAST(m AS INT) manifold FROM re JOIN s USING (root)")
def face_components(spark, d):
    return graph.manifolds(X.strips(spark, d)).select("fid", "manifold")


@query(RECURSIVE_STRIPS + _REACH + ", s AS (SELECT root, count(*) n FROM re GROUP BY root ORDER BY n DESC, root LIMIT 1) SELECT f.fid, v0, v1, v2 FROM f JOIN re ON re.f=f.fid WHERE re.root IN (SELECT root FROM s)")
def top_k_manifolds(spark, d):
    return graph.largest_manifolds(X.strips(spark, d), 1).faces.select("fid", "v0", "v1", "v2")


@query("SELECT CAST(m AS BIGINT) mesh_id, CAST(n AS BIGINT) n_components, t twisted FROM (VALUES (1,1,false),(3,1,false),(4,1,false),(5,2,false),(6,1,true),(7,1,false)) v(m,n,t) WHERE m <> 4")
def winding_parity_twist(spark, d):
    _, t = graph.winding(X.literal(spark, "square", "cube", "bowtie", "moebius", "ring"))
    return t.groupBy("mesh_id").agg(F.count("*").alias("n_components"), F.bool_or("twisted").alias("twisted"))


@query(RECURSIVE_PERFORATED + """, b AS (SELECT u, w FROM e WHERE n=1), l AS (SELECT u a, w b FROM b UNION ALL SELECT w, u FROM b), re(a, r) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, re.r FROM re JOIN l ON l.a=re.a),
 c AS (SELECT a, min(r) root FROM re GROUP BY a) SELECT root AS "loop", CAST(count(*) AS BIGINT) n FROM b JOIN c ON c.a=b.u GROUP BY root""")
def boundary_loops(spark, d):
    return graph.boundary_loops(X.perforated(spark, d)).select("loop", "n")


@query(RECURSIVE_GRID + """, nb AS (SELECT u vid, w nbr FROM e UNION ALL SELECT w, u FROM e), re(vid, d) AS (SELECT CAST(5025 AS BIGINT), 0 UNION SELECT nbr, d+1 FROM re JOIN nb USING (vid) WHERE d < 40) SELECT vid, CAST(min(d) AS DOUBLE) d FROM re GROUP BY vid""")
def hop_distance(spark, d):
    m = X.grid(spark, d)
    e = graph.weighted_edges(m, lambda a, b: F.lit(1.0))
    return graph.distances(e, m.vertices.where("vid = 5025").select("mesh_id", F.col("vid").alias("src"))).select("vid", "d")


@query("SELECT CAST(9048 AS BIGINT) dst, CAST(min(h) AS BIGINT) hops FROM (" + RECURSIVE_GRID + ", nb AS (SELECT u vid, w nbr FROM e UNION ALL SELECT w, u FROM e), re(vid, h) AS (SELECT CAST(5025 AS BIGINT), 0 UNION SELECT nbr, h+1 FROM re JOIN nb USING (vid) WHERE h < 40) SELECT h FROM re WHERE vid=9048) t")
def shortest_path_hops(spark, d):
    m = X.grid(spark, d)
    e = graph.weighted_edges(m, lambda a, b: F.lit(1.0))
    found = graph.distances(e, m.vertices.where("vid = 5025").select("mesh_id", F.col("vid").alias("src")))
    pairs = m.vertices.where("vid = 9048").select("mesh_id", F.lit(5025).cast("bigint").alias("src"), F.col("vid").alias("dst"))
    return graph.paths(found, pairs).groupBy("dst").agg(F.max("back").alias("hops"))


_ROUTES = RECURSIVE_GRID + """, nb AS (SELECT p.vid, q.vid nbr, sqrt((p.x-q.x)^2+(p.y-q.y)^2+(p.z-q.z)^2) {more} AS c FROM (SELECT u, w FROM e UNION ALL SELECT w, u FROM e) b JOIN v p ON p.vid=b.u JOIN v q ON q.vid=b.w),
 re(k, src, vid, d) AS (SELECT 0, vid, vid, CAST(0 AS DOUBLE) FROM v WHERE vid % 131 = 0 UNION ALL SELECT k+1, src, vid, min(d) FROM (SELECT k, src, nbr vid, d+c d FROM re JOIN nb USING (vid) UNION ALL SELECT k, src, vid, d FROM re) t WHERE k < 90 GROUP BY ALL)
 SELECT src, vid dst, round(d,6)+0.0 d FROM re WHERE k = 90 AND vid IN (5025, 9048, 1001)"""


def _ends(m):
    some = m.vertices.where("vid % 131 = 0")
    return some.select("mesh_id", F.col("vid").alias("src"), F.explode(F.array(*[F.lit(v).cast("bigint") for v in (5025, 9048, 1001)])).alias("dst"))


@query(_ROUTES.format(more=""))
def route_lengths(spark, d):
    m = X.grid(spark, d)
    return routes.routes(m, _ends(m))[0].select("src", "dst", r("d").alias("d"))


@query(_ROUTES.format(more="+ greatest(q.z-p.z, 0)*3"))
def route_costs(spark, d):
    """Going up costs more than going down."""
    m = X.grid(spark, d)
    found, _ = routes.routes(m, _ends(m), lambda a, b: (b - a).norm() + F.greatest(b.z - a.z, F.lit(0.0)) * 3)
    return found.select("src", "dst", r("d").alias("d"))


@query(GRID + """, nb AS (SELECT u vid, w nbr FROM e UNION ALL SELECT w, u FROM e), i AS (SELECT vid FROM v WHERE (x-25)^2+(y-5)^2 <= 16), o AS (SELECT vid, bool_or(nbr NOT IN (SELECT vid FROM i)) o FROM nb GROUP BY vid), b AS (SELECT DISTINCT unnest([u,w]) vid FROM e WHERE n=1)
 SELECT vid, o OR vid IN (SELECT vid FROM b) AS front FROM i JOIN o USING (vid)""")
def region_select(spark, d):
    m = X.grid(spark, d)
    flat = m.with_(vertices=m.vertices.withColumn("z", F.lit(0.0)))
    seed = m.faces.where("fid = 2 * 5025").select(F.lit(0).alias("rid"), "mesh_id", "fid", F.lit(25.0).alias("x"), F.lit(5.0).alias("y"), F.lit(0.0).alias("z"), F.lit(4.0).alias("r"))
    return graph.region(flat, seed).select("vid", "front")


@query(GRID + ", l AS (SELECT vid, CASE WHEN j < 20 THEN 0 WHEN j < 35 THEN 1 ELSE 2 END + CASE WHEN i < 5 THEN 0 ELSE 10 END lb FROM v) SELECT CAST(greatest(p.lb,q.lb) AS INT) p, CAST(least(p.lb,q.lb) AS INT) q, CAST(count(*) AS BIGINT) n FROM e JOIN l p ON p.vid=u JOIN l q ON q.vid=w WHERE p.lb<>q.lb GROUP BY 1, 2")
def saddle_edges(spark, d):
    m = X.grid(spark, d)
    j, i = F.col("vid") % 1000, (F.col("vid") / 1000).cast("int")
    lab = F.when(j < 20, 0).when(j < 35, 1).otherwise(2) + F.when(i < 5, 0).otherwise(10)
    return graph.saddle_edges(m, m.vertices.select("mesh_id", "vid", lab.alias("label"))).select("p", "q", "n")


# --- without SQL: sequential kernels, checked by tests ----------------------------------

_LOOPS = RECURSIVE_PERFORATED + """, b AS (SELECT u, w FROM e WHERE n=1), l AS (SELECT u a, w b FROM b UNION ALL SELECT w, u FROM b), re(a, r) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, re.r FROM re JOIN l ON l.a=re.a),
 c AS (SELECT a, min(r) root FROM re GROUP BY a), lo AS (SELECT root, CAST(count(*) AS BIGINT) n FROM b JOIN c ON c.a=b.u GROUP BY root), lk AS (SELECT *, row_number() OVER (ORDER BY n DESC, root)-1 k FROM lo)"""


@query(_LOOPS + " SELECT root first, n-2 n_faces FROM lk WHERE k > 0")
def fill_holes(spark, d):
    """Closes every loop of the perforated grid but the outer one, the longest."""
    m = X.grid(spark, d, (F.col("i") * 31 + F.col("j") * 17) % 11 != 0, "consistent")
    new = kernels.fill_holes(m, kernels.split_loops(m).where("loop > 0"))
    return new.groupBy("loop").agg(F.min(F.least("v0", "v1", "v2")).alias("first"), F.count("*").alias("n_faces")).select("first", "n_faces")


@query()
def fast_march(spark, d):
    m = X.grid(spark, d)
    return kernels.fast_march(m, m.vertices.where("vid = 5025").select("mesh_id", F.col("vid").alias("src"))).select("src", "vid", r("t").alias("t"))


@query()
def remesh_samples(spark, d):
    m = X.grid(spark, d)
    return kernels.remesh(m, m.vertices.where("vid = 1").select("mesh_id", F.col("vid").alias("src")), 8).select("vid", "label", r("t").alias("t"))


def _farthest(n: int) -> str:
    out = "s0 AS (SELECT *, CAST(1 AS BIGINT) AS label, (x-(SELECT x FROM v WHERE vid=1))^2+(y-(SELECT y FROM v WHERE vid=1))^2+(z-(SELECT z FROM v WHERE vid=1))^2 d2 FROM v)"
    for k in range(1, n):
        out += f", p{k} AS (SELECT vid s, x sx, y sy, z sz FROM s{k - 1} ORDER BY d2 DESC, vid LIMIT 1), s{k} AS (SELECT vid, x, y, z, CASE WHEN (x-sx)^2+(y-sy)^2+(z-sz)^2 < d2 THEN s ELSE label END AS label, least(d2, (x-sx)^2+(y-sy)^2+(z-sz)^2) d2 FROM s{k - 1}, p{k})"
    return f", {out} SELECT vid, label, round(d2,6)+0.0 d2 FROM s{n - 1}"


@query(GRID + _farthest(6))
def farthest_samples(spark, d):
    return graph.farthest_samples(X.grid(spark, d).vertices, 1, 6).select("vid", "label", r("d2").alias("d2"))


def _between(spark, d):
    m = X.grid(spark, d, winding="consistent")
    a, b, c = meshes.corner_vecs()
    mid = meshes.corners(m.vertices, m.faces).select("mesh_id", "fid", *((a + b + c) * (1 / 3)).columns())
    p = mid.where("fid = 2 * 2005").select("mesh_id", F.col("fid").alias("f0"), *[F.col(k).alias(f"{k}0") for k in "xyz"])
    q = mid.where("fid = 2 * 8040").select("mesh_id", F.col("fid").alias("f1"), *[F.col(k).alias(f"{k}1") for k in "xyz"])
    both = p.join(q, "mesh_id").withColumn("qid", F.lit(0).cast("bigint"))
    return m, both.withColumns({"nx": F.col("y1") - F.col("y0"), "ny": F.col("x0") - F.col("x1"), "nz": F.lit(0.0)})


@query()
def planar_path(spark, d):
    return kernels.planar_paths(*_between(spark, d)).select("qid", r("length").alias("length"), "n")


@query()
def unfolded_strip(spark, d):
    m = X.grid(spark, d)
    s = m.faces.where("fid in (2*5025, 2*5025+1)").select("mesh_id", F.lit(0).cast("bigint").alias("sid"), (F.col("fid") % 2).alias("pos"), "fid")
    return kernels.unfold_strips(m, s).select("vid", r("u").alias("u"), r("v").alias("v"))


@query(_LOOPS + ' SELECT CAST(k AS BIGINT) AS "loop", n FROM lk')
def split_boundary_loops(spark, d):
    return kernels.split_loops(X.grid(spark, d, (F.col("i") * 31 + F.col("j") * 17) % 11 != 0, "consistent")).groupBy("loop").agg(F.count("*").alias("n"))


@query()
def bending_energy(spark, d):
    p = X.points(spark, d)
    return bending.energies(p.select(F.col("mesh_id").alias("pid"), "vid", "x", "y", "z", (F.col("x") * 2).alias("tx"), (F.col("y") + F.col("x") * F.col("x")).alias("ty"), F.col("z").alias("tz"))).select("pid", r("energy").alias("energy"))


@query(GRID + " SELECT least(v0,v1,v2) v0, v0+v1+v2-least(v0,v1,v2)-greatest(v0,v1,v2) v1, greatest(v0,v1,v2) v2 FROM f")
def faces_from_edges(spark, d):
    e = topology.edges(X.grid(spark, d).faces)
    return kernels.faces_from_edges(e.select("mesh_id", F.col("u").alias("x"), F.col("w").alias("y"))).select("v0", "v1", "v2")


@query()
def icp_fit(spark, d):
    m = X.grid(spark, d, winding="consistent")
    t = frames.Transform.angle_axis(0.01, (0, 0, 1), (0.05, 0.02, 0.1))
    fit = frames.icp(t.apply(m.vertices), m, 5)
    return spark.createDataFrame([(i, float(round(x, 4))) for i, x in enumerate(fit.entries())], "k int, value double")


# --- further operators ------------------------------------------------------------------

@query(GRID + " SELECT fid, v0, v1, v2 FROM f WHERE fid % 4 <> 1")
def set_faces(spark, d):
    m = X.grid(spark, d)
    f = m.faces
    bad = f.where("fid % 4 = 1").select("mesh_id", "fid", "v0", "v1", F.when(F.col("fid") % 8 == 1, F.col("v0")).otherwise(F.lit(-5)).alias("v2"))
    again = f.where("fid % 4 = 0").select("mesh_id", (F.col("fid") + 10**6).alias("fid"), F.col("v1").alias("v0"), F.col("v2").alias("v1"), F.col("v0").alias("v2"))
    return meshes.set_faces(m.vertices, f.where("fid % 4 <> 1").unionByName(bad).unionByName(again)).faces.select("fid", "v0", "v1", "v2")


@query(GRID + " SELECT vid, round(x,6)+0.0 x, round(CASE WHEN vid%4=0 THEN y+0.5 ELSE y END,6)+0.0 y, round(CASE WHEN vid%4=0 THEN 1.0 ELSE z END,6)+0.0 z FROM v")
def move_vertices(spark, d):
    v = X.grid(spark, d).vertices
    u = v.where("vid % 4 = 0").select("mesh_id", "vid", "x", (F.col("y") + 0.5).alias("y"), F.lit(1.0).alias("z"))
    nan = v.where("vid % 4 = 1").select("mesh_id", "vid", F.lit(float("nan")).alias("x"), "y", "z")
    return edit.move(v, u.unionByName(nan)).select("vid", *xyz())


@query(GRID + CORNERS + _CURVED + """, fd AS (SELECT f.fid, c.nx*(a.ny*b.nz-a.nz*b.ny)+c.ny*(a.nz*b.nx-a.nx*b.nz)+c.nz*(a.nx*b.ny-a.ny*b.nx) det FROM f JOIN cu a ON a.vid=v0 JOIN cu b ON b.vid=v1 JOIN cu c ON c.vid=v2)
 SELECT a AS vid, round(avg(det),6)+0.0 det FROM fe JOIN fd USING (fid) GROUP BY a""")
def vertex_determinants(spark, d):
    m = X.grid(spark, d)
    return measure.curvature_metrics(m, measure.curvature(m))[1].select("vid", r("det").alias("det"))


_LABELS = "l AS (SELECT vid, x, y, z, CASE WHEN j < 20 THEN 0 ELSE 1 END lb, CAST(abs(j-20) AS DOUBLE) t, 1.0+(vid%3) f FROM v)"


@query(GRID + ", " + _LABELS + """, nb AS (SELECT u vid, w nbr FROM e UNION ALL SELECT w, u FROM e),
 p AS (SELECT a.vid, a.x ax, a.y ay, a.z az, b.x bx, b.y by_, b.z bz, a.t ta, b.t tb, a.f fa, b.f fb, sqrt((a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2) dd FROM nb JOIN l a ON a.vid=nb.vid JOIN l b ON b.vid=nbr WHERE a.lb<>b.lb),
 k AS (SELECT *, (tb-ta+fb*dd)/(dd*(fa+fb)) s FROM p), g AS (SELECT vid, count(*) n, sum(ax+s*(bx-ax)) sx, sum(ay+s*(by_-ay)) sy, sum(az+s*(bz-az)) sz FROM k GROUP BY vid)
 SELECT vid, round((4*x+coalesce(sx,0))/(4+coalesce(n,0)),6)+0.0 x, round((4*y+coalesce(sy,0))/(4+coalesce(n,0)),6)+0.0 y, round((4*z+coalesce(sz,0))/(4+coalesce(n,0)),6)+0.0 z FROM l LEFT JOIN g USING (vid)""")
def interpolated_vertices(spark, d):
    m = X.grid(spark, d)
    j = F.col("vid") % 1000
    lab = m.vertices.select("mesh_id", "vid", F.when(j < 20, 0).otherwise(1).alias("label"), F.abs(j - 20).cast("double").alias("t"), (1.0 + F.col("vid") % 3).alias("f"))
    return graph.interpolated(m, lab).select("vid", *xyz())


@query(GRID + " SELECT vid AS uvid FROM v WHERE vid NOT IN (SELECT a FROM fe WHERE fid % 5 <> 0 AND fid % 3 = 0)")
def unused_uvs(spark, d):
    m = _textured(spark, d)
    return texture.unused_uvs(m.uvs, m.face_uvs.where("fid % 3 = 0")).select("uvid")


@query(GRID + " SELECT fid FROM f WHERE fid % 2 = 0 AND fid % 5 <> 0")
def remove_materials(spark, d):
    m = _textured(spark, d)
    m = m.with_(face_uvs=m.face_uvs.withColumn("mid", F.col("fid") % 2), materials=None)
    return texture.remove_materials(m, spark.createDataFrame([(0, 1)], "mesh_id bigint, mid bigint")).face_uvs.select("fid")


@query("SELECT CAST(n_nationkey+k*10 AS BIGINT) mid, CAST(CASE WHEN k=1 THEN 100 ELSE 0 END+n_nationkey AS BIGINT) n FROM nation, (SELECT unnest([0,1]) k) t WHERE k=1 OR n_nationkey < 10")
def copy_materials(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    one = lambda first, more: n.select(F.lit(0).cast("bigint").alias("mesh_id"), (F.col("n_nationkey") + first).cast("bigint").alias("mid"), (F.col("n_nationkey") + more).cast("int").alias("rows"), F.lit(2).alias("cols"), F.lit(None).cast("binary").alias("texture"))
    return texture.copy_materials(one(0, 0), one(10, 100)).select("mid", F.col("rows").cast("bigint").alias("n"))


@query(GRID + " SELECT CASE WHEN v0//1000 <= 5 THEN 0 ELSE 1 END AS manifold, CAST(count(*) AS BIGINT) n FROM f GROUP BY 1")
def components_behind_a_line(spark, d):
    m = X.grid(spark, d)
    row = lambda c: F.floor(F.col(c) / 1000)
    parts = graph.manifolds(m, ~((row("u") == 5) & (row("w") == 5)))
    return parts.groupBy("manifold").agg(F.count("*").alias("n"))


@query(CLOUD + """, t AS (SELECT a.vid, a.x ax, a.y ay, a.z az, b.x bx, b.y by_, b.z bz, c.x cx, c.y cy, c.z cz FROM p a JOIN p b ON b.vid=a.vid+1 JOIN p c ON c.vid=a.vid+2),
 s AS (SELECT *, bx-ax ux, by_-ay uy, bz-az uz, cx-ax vx, cy-ay vy, cz-az vz FROM t), q AS (SELECT *, uy*vz-uz*vy nx, uz*vx-ux*vz ny, ux*vy-uy*vx nz, sqrt(ux*ux+uy*uy+uz*uz) lu, sqrt(vx*vx+vy*vy+vz*vz) lv, ux*vx+uy*vy+uz*vz dt FROM s)
 SELECT vid, round(sqrt(nx*nx+ny*ny+nz*nz)/2,6)+0.0 area, round(dt/(lu*lv),6)+0.0 cosine, round(acos(greatest(-1,least(1,dt/(lu*lv)))),6)+0.0 angle, round(ax-2*ax,6)+0.0 mirror_x, round(lu,6)+0.0 gx, round((ax+bx)/2,6)+0.0 mid_x, round(2*ax-az+1,6)+0.0 tx FROM q""")
def scalar_geometry(spark, d):
    p = X.points(spark, d)
    at = lambda k, n: p.select((F.col("vid") - k).alias("vid"), *Vec.of().columns(n))
    j = at(0, "a").join(at(1, "b"), "vid").join(at(2, "c"), "vid")
    a, b, c = (Vec.of(n) for n in "abc")
    g = vec.givens((b - a).norm(), F.lit(0.0))
    m = vec.affine([2, 0, -1, 1, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], a)
    return j.select("vid", r(vec.area(a, b, c)).alias("area"), r(vec.cosine(a, b, c)).alias("cosine"), r(vec.angle(b - a, c - a)).alias("angle"), r(vec.reflect(a, Vec(0, 0, 0), Vec(1, 0, 0)).x).alias("mirror_x"), r(g["r"]).alias("gx"), r(vec.lerp(a, b, F.lit(0.5)).x).alias("mid_x"), r(m.x).alias("tx"))


@query(GRID + CORNERS + """, a AS (SELECT fid, (x0+x1+x2)/3 cx, (y0+y1+y2)/3 cy FROM k) SELECT CAST(0 AS BIGINT) qid, round(sqrt((p.cx-q.cx)^2+(p.cy-q.cy)^2),6)+0.0 length FROM a p, a q WHERE p.fid = 2*2005 AND q.fid = 2*8040""")
def straight_path_on_a_plane(spark, d):
    m, q = _between(spark, d)
    flat = q.withColumns({"z0": F.lit(0.0), "z1": F.lit(0.0)})
    return kernels.straight_paths(m.with_(vertices=m.vertices.withColumn("z", F.lit(0.0))), flat).select("qid", r("length").alias("length"))


@query(GRID + CORNERS + """, a AS (SELECT fid, (x0+x1+x2)/3 cx, (y0+y1+y2)/3 cy FROM k) SELECT CAST(0 AS BIGINT) qid, round(sqrt((p.cx-q.cx)^2+(p.cy-q.cy)^2),6)+0.0 length FROM a p, a q WHERE p.fid = 2*2005 AND q.fid = 2*8040""")
def planar_path_on_a_plane(spark, d):
    m, q = _between(spark, d)
    flat = q.withColumns({"z0": F.lit(0.0), "z1": F.lit(0.0)})
    return kernels.planar_paths(m.with_(vertices=m.vertices.withColumn("z", F.lit(0.0))), flat).select("qid", r("length").alias("length"))


@query(GRID + CORNERS + "," + CLOUD[5:] + """, q AS (SELECT vid qid, CAST(CASE WHEN vid%2=0 THEN 5025 ELSE 3010 END AS BIGINT) spot, x*40+25 qx, y*8+5 qy, z*20+50 qz FROM p),
 s AS (SELECT qid, fid, (x0+x1+x2)/3-v.x ax, (y0+y1+y2)/3-v.y ay, (z0+z1+z2)/3-v.z az, qx-v.x bx, qy-v.y by_, qz-v.z bz FROM q JOIN v ON v.vid=spot JOIN k ON spot IN (v0,v1,v2))
 SELECT qid, fid FROM (SELECT qid, fid, row_number() OVER (PARTITION BY qid ORDER BY (ax*bx+ay*by_+az*bz)/sqrt(ax*ax+ay*ay+az*az)/sqrt(bx*bx+by_*by_+bz*bz) DESC, fid) n FROM s) t WHERE n = 1""")
def aligned_faces(spark, d):
    p = X.all_probes(spark, d).withColumn("vid", F.when(F.col("qid") % 2 == 0, 5025).otherwise(3010).cast("bigint"))
    return spatial.aligned_faces(p, X.grid(spark, d)).select("qid", "fid")


# --- a mesh that grows with the tables -----------------------------------------------

@query(TERRAIN + CORNERS + """ SELECT CAST((SELECT count(*) FROM v) AS BIGINT) n_v, CAST((SELECT count(*) FROM f) AS BIGINT) n_f, CAST(count(*) AS BIGINT) n_e,
 CAST(sum(CASE WHEN n=1 THEN 1 ELSE 0 END) AS BIGINT) n_boundary, round((SELECT sum(sqrt(nx*nx+ny*ny+nz*nz))/2 FROM fv),4) area FROM e""")
def terrain_summary(spark, d):
    return topology.summary(X.terrain(spark, d)).select("n_v", "n_f", "n_e", "n_boundary", r("area", 4).alias("area"))


@query(TERRAIN + CORNERS + _CURVED + " SELECT vid, " + rr("kp1", "kp2") + " FROM cu")
def terrain_curvature(spark, d):
    return measure.curvature(X.terrain(spark, d)).select("vid", r("kp1").alias("kp1"), r("kp2").alias("kp2"))


@query(TERRAIN + " SELECT DISTINCT unnest([u,w]) vid FROM e WHERE n=1")
def terrain_boundary(spark, d):
    return topology.boundary_vertices(X.terrain(spark, d).faces).select("vid")


@query(TERRAIN + CORNERS + " SELECT fid*4+k fid, round(area/4,6)+0.0 area FROM (SELECT fid, unnest([0,1,2,3]) k, sqrt(nx*nx+ny*ny+nz*nz)/2 area FROM fv) t")
def terrain_subdivide(spark, d):
    return measure.face_geometry(edit.split_midpoints(X.terrain(spark, d))).select("fid", r("area").alias("area"))


# --- UVs through edits ---------------------------------------------------------------

#: u and v of a corner k of a face of the textured grid
_UV = "round(x{0}/50,6)+0.0 u{0}, round(y{0}/10,6)+0.0 v{0}"


def _corner_rows(m: MeshFrame) -> DataFrame:
    return texture.corner_uvs(m).select("fid", F.col("slot").cast("bigint").alias("slot"), "vid", r("u").alias("u"), r("v").alias("v"))


_CORNER = "(SELECT fid, slot, a AS vid FROM fe) c JOIN v USING (vid)"


@query(GRID + f" SELECT fid, CAST(CASE WHEN fid%2=0 THEN 2-slot ELSE slot END AS BIGINT) slot, vid, round(x/50,6)+0.0 u, round(y/10,6)+0.0 v FROM {_CORNER} WHERE fid%5<>0")
def turned_uvs(spark, d):
    m = _textured(spark, d)
    return _corner_rows(edit.turned(m, m.faces.where("fid % 2 = 0")))


@query(GRID + CORNERS + """, t AS (SELECT *, unnest([0,1,2]) q FROM k WHERE fid%5<>0), o AS (SELECT fid*3+q fid, CASE q WHEN 0 THEN [x0,x1,(x0+x1+x2)/3] WHEN 1 THEN [x1,x2,(x0+x1+x2)/3] ELSE [x2,x0,(x0+x1+x2)/3] END xs,
 CASE q WHEN 0 THEN [y0,y1,(y0+y1+y2)/3] WHEN 1 THEN [y1,y2,(y0+y1+y2)/3] ELSE [y2,y0,(y0+y1+y2)/3] END ys FROM t)
 SELECT fid, CAST(unnest([0,1,2]) AS BIGINT) slot, round(unnest(xs)/50,6)+0.0 u, round(unnest(ys)/10,6)+0.0 v FROM o""")
def subdivided_uvs(spark, d):
    return _corner_rows(edit.subdivided(_textured(spark, d))).drop("vid")


def _pieces(x: str) -> str:
    """Corners of the four pieces of a face by its midpoints."""
    a, b, c = (f"({x}{k}+{x}{(k + 1) % 3})/2" for k in range(3))
    return f"CASE q WHEN 0 THEN [{x}0,{a},{c}] WHEN 1 THEN [{a},{x}1,{b}] WHEN 2 THEN [{c},{b},{x}2] ELSE [{a},{b},{c}] END"


@query(GRID + CORNERS + f""", t AS (SELECT *, unnest([0,1,2,3]) q FROM k WHERE fid%5<>0), o AS (SELECT fid*4+q fid, {_pieces("x")} xs, {_pieces("y")} ys FROM t)
 SELECT fid, CAST(unnest([0,1,2]) AS BIGINT) slot, round(unnest(xs)/50,5)+0.0 u, round(unnest(ys)/10,5)+0.0 v FROM o""")
def midpoint_uvs(spark, d):
    return texture.corner_uvs(edit.split_midpoints(_textured(spark, d))).select("fid", F.col("slot").cast("bigint").alias("slot"), r("u", 5).alias("u"), r("v", 5).alias("v"))


@query(GRID + CORNERS + """, h AS (SELECT *, (CASE WHEN z0>=50 THEN 1 ELSE 0 END)+(CASE WHEN z1>=50 THEN 1 ELSE 0 END)+(CASE WHEN z2>=50 THEN 1 ELSE 0 END) n FROM k WHERE fid%5<>0),
 g AS (SELECT fid, unnest([[x0,y0,z0,x1,y1,z1],[x1,y1,z1,x2,y2,z2],[x2,y2,z2,x0,y0,z0]]) e FROM h WHERE n IN (1,2)),
 c AS (SELECT fid, e[1]+(e[4]-e[1])*(50-e[3])/(e[6]-e[3]) x, e[2]+(e[5]-e[2])*(50-e[3])/(e[6]-e[3]) y FROM g WHERE (e[3]>=50)<>(e[6]>=50)),
 w AS (SELECT fid, unnest([x0,x1,x2]) x, unnest([y0,y1,y2]) y, unnest([z0,z1,z2]) z FROM h WHERE n > 0),
 o AS (SELECT fid, x, y FROM w WHERE z >= 50 UNION ALL SELECT fid, x, y FROM c)
 SELECT DISTINCT fid, round(x/50,4)+0.0 u, round(y/10,4)+0.0 v FROM o""")
def sliced_uvs(spark, d):
    """The UVs of the corners that a face's pieces have above the plane z = 50."""
    m = edit.sliced(_textured(spark, d), (0, 0, 50), (0, 0, 1))
    return texture.corner_uvs(m).select(F.floor(F.col("fid") / 2).cast("bigint").alias("fid"), r("u", 4).alias("u"), r("v", 4).alias("v")).distinct()


@query(GRID + CORNERS + """ SELECT fid, CAST(unnest([0,1,2]) AS BIGINT) slot, round(unnest([x0,x1,x2])/50,5)+0.0 u, round(unnest([y0,y1,y2])/10,5)+0.0 v FROM k WHERE fid%5<>0""")
def tetra_uvs(spark, d):
    """Centroid splits undone: the bases have the corners and UVs of the faces that were split."""
    split = edit.subdivided(_textured(spark, d))
    split = split.with_(**{k: stored(getattr(split, k)) for k in ("vertices", "faces", "uvs", "face_uvs")})
    whole = edit.without_tetrahedra(split)
    back = texture.corner_uvs(whole).join(X.grid(spark, d).faces.select("mesh_id", F.col("fid").alias("old"), F.posexplode(F.array("v0", "v1", "v2")).alias("at", "vid")), ["mesh_id", "vid"]).where("old = floor(fid / 3)")
    return back.select(F.col("old").alias("fid"), F.col("at").cast("bigint").alias("slot"), r("u", 5).alias("u"), r("v", 5).alias("v"))


@query(GRID + """, g AS (SELECT vid d, vid-1001 a, vid-1 b, vid-1000 c FROM v WHERE vid IN (SELECT v0 FROM f)), h AS (SELECT * FROM g WHERE (2*d)%5<>0 AND (2*d+1)%5<>0),
 t AS (SELECT least(d,b,c) p, greatest(d,b,c) q, unnest([d,b,c]) vid FROM h UNION ALL SELECT least(a,b,c), greatest(a,b,c), unnest([a,b,c]) FROM h)
 SELECT p, q, vid, round(x/50,6)+0.0 u, round(y/10,6)+0.0 v FROM t JOIN v USING (vid)""")
def flipped_uvs(spark, d):
    m = _textured(spark, d)
    out = edit.flipped_mesh(m, topology.edges(m.faces).where("w - u = 1001"))
    ends = out.faces.select("fid", F.least("v0", "v1", "v2").alias("p"), F.greatest("v0", "v1", "v2").alias("q"))
    return _corner_rows(out).join(ends, "fid").select("p", "q", "vid", "u", "v")


@query(GRID + ", n AS (SELECT fid, row_number() OVER (ORDER BY fid)-1 k FROM f), m AS (SELECT vid, row_number() OVER (ORDER BY vid)-1 nv FROM v)" + f" SELECT CAST(k AS BIGINT) fid, CAST(slot AS BIGINT) slot, CAST(nv AS BIGINT) vid, round(x/50,6)+0.0 u, round(y/10,6)+0.0 v FROM {_CORNER} JOIN n USING (fid) JOIN m USING (vid) WHERE fid%5<>0")
def repacked_uvs(spark, d):
    return _corner_rows(meshes.repacked(_textured(spark, d)))


@query(GRID + f" SELECT x+100*k x, y, round(x/50+k,6)+0.0 u, round(y/10,6)+0.0 v, CAST(count(*) AS BIGINT) n FROM {_CORNER}, (SELECT unnest([0,1]) k) t WHERE fid%5<>0 GROUP BY ALL")
def union_uvs(spark, d):
    m = _textured(spark, d)
    far = m.with_(vertices=m.vertices.withColumn("x", F.col("x") + 100), uvs=m.uvs.withColumn("u", F.col("u") + 1))
    both = meshes.union(m, far)
    rows = texture.corner_uvs(both).join(both.vertices, ["mesh_id", "vid"])
    return rows.groupBy("x", "y", r("u").alias("u"), r("v").alias("v")).agg(F.count("*").alias("n"))


@query(GRID + " SELECT DISTINCT unnest([v0,v1,v2]) uvid FROM f WHERE fid%5<>0 AND fid%3=0")
def subset_uvs(spark, d):
    m = _textured(spark, d)
    return meshes.face_subset(m, m.faces.where("fid % 3 = 0")).uvs.select("uvid")


@query(GRID + f" SELECT fid, CAST(slot AS BIGINT) slot, vid, round(j/50.0,6)+0.0 u, round(i/11.0,6)+0.0 v FROM {_CORNER}")
def draped_uvs(spark, d):
    m = X.grid(spark, d)
    image = spark.createDataFrame([(0, 11, 50, b"")], "mesh_id bigint, rows int, cols int, texture binary")
    cells = m.vertices.select("mesh_id", "vid", F.floor(F.col("vid") / 1000).alias("i"), (F.col("vid") % 1000).alias("j"))
    return _corner_rows(texture.draped(m, cells, 11, 50, image))


# --- frames, planes and curvature ----------------------------------------------------

@query(GRID + CORNERS + _CURVED[: _CURVED.index(" cu AS")].rstrip(",\n ") + """, gv AS (SELECT h3.vid, ca, cb, sqrt(ca*ca+cb*cb) gr, q2x, q2y, q2z, q3x, q3y, q3z FROM h3 JOIN h4 USING (vid)), gd AS (SELECT *, ca/gr gc, -cb/gr gs FROM gv WHERE gr > 1e-6)
 SELECT vid, round(gc*q2x-gs*q3x,4)+0.0 d1x, round(gc*q2y-gs*q3y,4)+0.0 d1y, round(gc*q2z-gs*q3z,4)+0.0 d1z, round(gs*q2x+gc*q3x,4)+0.0 d2x, round(gs*q2y+gc*q3y,4)+0.0 d2y, round(gs*q2z+gc*q3z,4)+0.0 d2z FROM gd""")
def principal_directions(spark, d):
    c = measure.curvature(X.grid(spark, d))
    flat = F.hypot((3 * F.col("kp1") + F.col("kp2")) / 8, (F.col("kp1") + 3 * F.col("kp2")) / 8) > 1e-6  # the tensor's diagonal
    return c.where(flat).select("vid", *[r(f"d{k}{a}", 4).alias(f"d{k}{a}") for k in (1, 2) for a in "xyz"])


@query(GRID.replace("AS DOUBLE) y, z FROM", "AS DOUBLE) y, CASE WHEN i=5 AND j IN (20,25) THEN z+3 ELSE z END z FROM") + CORNERS + _CURVED + " SELECT vid, " + rr("kp1", "kp2") + " FROM cu")
def moved_curvature(spark, d):
    m = X.grid(spark, d)
    up = m.vertices.where("vid in (5020, 5025)").withColumn("z", F.col("z") + 3)
    return measure.moved_curvature(m, measure.curvature(m), up)[1].select("vid", r("kp1").alias("kp1"), r("kp2").alias("kp2"))


@query(CLOUD + """, t AS (SELECT a.vid, a.x ax, a.y ay, a.z az, b.x bx, b.y by_, b.z bz, c.x cx, c.y cy, c.z cz FROM p a JOIN p b ON b.vid=a.vid+1 JOIN p c ON c.vid=a.vid+2),
 u AS (SELECT *, sqrt(ax*ax+ay*ay) r, ax*bx+ay*by_+az*bz ab, bx*bx+by_*by_+bz*bz bb, bx*cx+by_*cy+bz*cz bc FROM t)
 SELECT vid, round(ax/r,6)+0.0 c, round(-ay/r,6)+0.0 s, round(r,6)+0.0 r, round(ax-bx*(ab-bb)/bb,6)+0.0 px, round(ay-by_*(ab-bb)/bb,6)+0.0 py, round(az-bz*(ab-bb)/bb,6)+0.0 pz, round((ab-bb)/sqrt(bb),6)+0.0 dist,
 least(ax,bx) lx, greatest(ax,bx) hx, least(ay,by_) ly, greatest(ay,by_) hy, least(az,bz) lz, greatest(az,bz) hz, round(ax+(bx-ax)/3,6)+0.0 mx, round(ay+(by_-ay)/3,6)+0.0 my, round(az+(bz-az)/3,6)+0.0 mz FROM u""")
def plane_geometry(spark, d):
    """Rotations, projections into planes, boxes of two corners, meetings of lines."""
    p = X.points(spark, d)
    at = lambda k, n: p.select((F.col("vid") - k).alias("vid"), *Vec.of().columns(n))
    j = at(0, "a").join(at(1, "b"), "vid").join(at(2, "c"), "vid")
    a, b, c = (Vec.of(n) for n in "abc")
    g = vec.givens(a.x, a.y)
    on = vec.project_to_plane(a, b, b)
    cross = vec.line_intersection(a, b, a + (b - a) * (1 / 3) - (c - a), a + (b - a) * (1 / 3) + (c - a) * 2)
    names = ("lx", "hx", "ly", "hy", "lz", "hz")
    return j.select("vid", *[r(g[k]).alias(k) for k in ("c", "s", "r")], *[r(x).alias(f"p{k}") for k, x in zip("xyz", on, strict=True)], r(vec.signed_distance(a, b, b.unit())).alias("dist"), *[x.alias(n) for x, n in zip(vec.box6(a, b), names, strict=True)], *[r(x).alias(f"m{k}") for k, x in zip("xyz", cross, strict=True)])


@query(CLOUD + """, t AS (SELECT vid, x+1 x, y+2 y, z+3 z FROM p), u AS (SELECT vid, x*cos(0.3)-y*sin(0.3) x, x*sin(0.3)+y*cos(0.3) y, z FROM t) SELECT vid, round(2*x,6)+0.0 x, round(2*y,6)+0.0 y, round(2*z,6)+0.0 z FROM u""")
def transform_chain(spark, d):
    p = X.points(spark, d)
    t = frames.Transform.translation((1, 2, 3)).then(frames.Transform.angle_axis(0.3, (0, 0, 1))).then(frames.Transform.rotation([[2.0, 0, 0], [0, 2.0, 0], [0, 0, 2.0]], (0, 0, 0)))
    return t.apply(p).select("vid", *xyz())


@query(CLOUD + """, b AS (SELECT mesh_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM p GROUP BY mesh_id)
 SELECT mesh_id, round(1-y0,6)+0.0 min_x, round(1-y1,6)+0.0 max_x, round(x0,6)+0.0 min_y, round(x1,6)+0.0 max_y, round(z0+2,6)+0.0 min_z, round(z1+2,6)+0.0 max_z,
 round(1-y1,6)+0.0 ext_min_x, round(1-y0,6)+0.0 ext_max_x, round(x0,6)+0.0 ext_min_y, round(x1,6)+0.0 ext_max_y FROM b""")
def turned_boxes(spark, d):
    m = [0.0, -1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 0.0, 0.0, 0.0, 1.0]
    boxes = measure.bounds(X.points(spark, d))
    ext = measure.framed_boxes(boxes, m).select("mesh_id", *[r(f"ext_{n}_{a}").alias(f"ext_{n}_{a}") for a in "xy" for n in ("min", "max")])
    return measure.fixed_boxes(boxes, m).select("mesh_id", *[r(f"{n}_{a}").alias(f"{n}_{a}") for a in "xyz" for n in ("min", "max")]).join(ext, "mesh_id")


# --- more of graphs and edits --------------------------------------------------------

@query(STRIPS + CORNERS + """, c AS (SELECT fid, nz > 0 up, CASE WHEN v0%1000 <= 23 THEN 0 ELSE 1 END part FROM fv), r AS (SELECT part, min(fid) root FROM c GROUP BY part)
 SELECT c.fid, r.root, CAST(CASE WHEN c.up = q.up THEN 1 ELSE -1 END AS BIGINT) sign FROM c JOIN r USING (part) JOIN c q ON q.fid = r.root""")
def winding_signs(spark, d):
    return graph.winding(X.strips(spark, d))[0].select("fid", "root", F.col("sign").cast("bigint").alias("sign"))


@query(RECURSIVE_STRIPS + """, part AS (SELECT fid, v0, v1, v2, CASE WHEN v0%1000 <= 23 THEN 0 ELSE 1 END s FROM f), n AS (SELECT s, count(*) k, row_number() OVER (ORDER BY count(*) DESC, min(fid))-1 manifold FROM part GROUP BY s),
 pv AS (SELECT s, count(DISTINCT vid) k FROM (SELECT s, unnest([v0,v1,v2]) vid FROM part) t GROUP BY s), pe AS (SELECT s, u, w, count(*) c FROM fe JOIN part USING (fid) GROUP BY s, u, w), pb AS (SELECT s, count(*) k FROM pe WHERE c%2=1 GROUP BY s)
 SELECT CAST(manifold AS BIGINT) manifold, CAST(n.k AS BIGINT) n_faces, CAST(pv.k AS BIGINT) n_vertices, CAST(pb.k AS BIGINT) n_boundary FROM n JOIN pv USING (s) JOIN pb USING (s)""")
def manifold_parts(spark, d):
    m = X.strips(spark, d)
    return graph.manifold_parts(m, graph.manifolds(m)).select(F.col("manifold").cast("bigint").alias("manifold"), "n_faces", "n_vertices", "n_boundary")


@query(GRID + CORNERS + """, a AS (SELECT sqrt(nx*nx+ny*ny+nz*nz)/2 area FROM fv), k AS (SELECT area, CASE WHEN area <= 2.5 THEN 1 ELSE power(3, ceil(ln(area/2.5)/ln(3)-1e-12)) END n FROM a)
 SELECT CAST(sum(n) AS BIGINT) n_f, CAST((SELECT count(*) FROM v)+sum((n-1)/2) AS BIGINT) n_v, round(sum(area),5)+0.0 area FROM k""".replace("k AS (SELECT area", "kk AS (SELECT area").replace("FROM k\"", "FROM kk\"").replace("area FROM k", "area FROM kk"))
def split_to_area(spark, d):
    s = topology.summary(edit.split_to_area(X.grid(spark, d), 2.5))
    return s.select("n_f", "n_v", r("area", 5).alias("area"))


@query()
def surface_path(spark, d):
    q = spark.createDataFrame([(0, 3.2, 1.1, 50.0, 44.7, 8.6, 50.0), (1, 10.0, 9.3, 40.0, 12.5, 0.4, 60.0)], "qid bigint, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    return graph.path_lengths(surface.surface_paths(q, X.grid(spark, d)), "qid").select("qid", r("length").alias("length"))


@query(GRID + CORNERS + """, a AS (SELECT fid, (x0+x1+x2)/3 cx, (y0+y1+y2)/3 cy FROM k) SELECT CAST(0 AS BIGINT) qid, round(sqrt((p.cx-q.cx)^2+(p.cy-q.cy)^2),6)+0.0 length FROM a p, a q WHERE p.fid = 2*2005 AND q.fid = 2*8040""")
def facet_path_on_a_plane(spark, d):
    m, q = _between(spark, d)
    flat = q.withColumns({"z0": F.lit(0.0), "z1": F.lit(0.0)})
    level = m.with_(vertices=m.vertices.withColumn("z", F.lit(0.0)))
    plane = flat.select("mesh_id", (F.col("y0") - F.col("y1")).alias("nx"), (F.col("x1") - F.col("x0")).alias("ny"), F.lit(0.0).alias("nz"))
    return surface.facet_paths(level, flat, m.faces.select("mesh_id", "fid").join(plane, "mesh_id")).select("qid", r("length").alias("length"))


@query(GRID + CORNERS + " SELECT fid, round(greatest(z0,z1,z2)-least(z0,z1,z2),6)+0.0 rise FROM k")
def visited_faces(spark, d):
    import pyarrow as pa
    import pyarrow.compute as pc

    def rise(b: pa.RecordBatch) -> pa.RecordBatch:
        z = [b.column(f"z{k}") for k in range(3)]
        return pa.RecordBatch.from_arrays([b.column("fid"), pc.subtract(pc.max_element_wise(*z), pc.min_element_wise(*z))], names=["fid", "rise"])

    return surface.visit(X.grid(spark, d), rise, "fid bigint, rise double").select("fid", r("rise").alias("rise"))


# --- whole tables: every row searches all rows ----------------------------------------

ALL_PROBES = PROBES.replace(" WHERE vid < 40", "")


@query(CLOUD + ", h AS (SELECT a.vid qid, b.vid vid, (a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2 d2 FROM p a, p b), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, vid) k FROM h) SELECT qid, CAST(k AS INT) k, vid, round(d2,6)+0.0 d2 FROM k WHERE k <= 5")
def knn_vertices_all(spark, d):
    p = X.points(spark, d)
    return spatial.nearest(p.withColumnRenamed("vid", "qid"), p, 5).select("qid", "k", "vid", r("d2").alias("d2"))


@query()
def find_faces_all(spark, d):
    m = X.grid(spark, d)
    t = m.vertices.select("mesh_id", F.col("vid").alias("qid"), (F.col("vid") - 1001).alias("v0"), F.col("vid").alias("v1"), (F.col("vid") - 1).alias("v2"))
    return topology.find_faces(m.faces, t).select("qid", "fid")


@query()
def fill_holes_all(spark, d):
    """Closes every loop of the perforated grid but the outer one, the longest."""
    m = X.grid(spark, d, (F.col("i") * 31 + F.col("j") * 17) % 11 != 0, "consistent")
    return kernels.fill_holes(m, kernels.split_loops(m).where("loop > 0")).select("loop", "k", "v0", "v1", "v2")


@query(CLOUD + ALL_PROBES + ", h AS (SELECT a.qid, b.qid*100 vid, (a.qx-b.qx)^2+(a.qy-b.qy)^2+(a.qz-b.qz)^2 d2 FROM q a, q b), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, vid) k FROM h) SELECT qid, CAST(k AS INT) k, vid, round(d2,6)+0.0 d2 FROM k WHERE k <= 2")
def nearest_vertex_all(spark, d):
    p = X.all_probes(spark, d)
    return spatial.nearest(p, p.select((F.col("qid") * 100).alias("vid"), "x", "y", "z"), 2).select("qid", "k", "vid", r("d2").alias("d2"))


_ON_FACE = "WITH " + _grid() + CORNERS + ", " + CLOUD[5:] + ALL_PROBES + f""", j AS (SELECT q.*, fv.*, {_segment(0, 1)} t0, {_segment(1, 2)} t1, {_segment(2, 0)} t2, ((qx-x0)*nx+(qy-y0)*ny+(qz-z0)*nz)/(nx*nx+ny*ny+nz*nz) h FROM q, fv),
 c AS (SELECT *, (((y2-y1)*(qz-z1)-(z2-z1)*(qy-y1))*nx+((z2-z1)*(qx-x1)-(x2-x1)*(qz-z1))*ny+((x2-x1)*(qy-y1)-(y2-y1)*(qx-x1))*nz) b0, (((y0-y2)*(qz-z2)-(z0-z2)*(qy-y2))*nx+((z0-z2)*(qx-x2)-(x0-x2)*(qz-z2))*ny+((x0-x2)*(qy-y2)-(y0-y2)*(qx-x2))*nz) b1, (((y1-y0)*(qz-z0)-(z1-z0)*(qy-y0))*nx+((z1-z0)*(qx-x0)-(x1-x0)*(qz-z0))*ny+((x1-x0)*(qy-y0)-(y1-y0)*(qx-x0))*nz) b2 FROM j),
 o AS (SELECT qid, qx, qy, qz, qx-h*nx x, qy-h*ny y, qz-h*nz z FROM c WHERE b0>=0 AND b1>=0 AND b2>=0 UNION ALL SELECT qid, qx, qy, qz, x0+t0*(x1-x0), y0+t0*(y1-y0), z0+t0*(z1-z0) FROM c UNION ALL SELECT qid, qx, qy, qz, x1+t1*(x2-x1), y1+t1*(y2-y1), z1+t1*(z2-z1) FROM c UNION ALL SELECT qid, qx, qy, qz, x2+t2*(x0-x2), y2+t2*(y0-y2), z2+t2*(z0-z2) FROM c),
 b AS (SELECT qid, x, y, z, (x-qx)^2+(y-qy)^2+(z-qz)^2 d2 FROM o)
 SELECT qid, round(min(d2),6)+0.0 d2, round(arg_min(x, d2),4)+0.0 x, round(arg_min(y, d2),4)+0.0 y, round(arg_min(z, d2),4)+0.0 z FROM b GROUP BY qid"""


@query(_ON_FACE)
def closest_surface_point_all(spark, d):
    return spatial.closest_surface_point(X.all_probes(spark, d), X.grid(spark, d)).select("qid", r("d2").alias("d2"), *[r(a, 4).alias(a) for a in "xyz"])


_RAYS = "WITH " + _grid() + CORNERS + ", " + CLOUD[5:] + ALL_PROBES + """, ry AS (SELECT qid, qx, qy, qz, {ux} ux, {uy} uy, {uz} uz FROM (SELECT qid, qx, qy, {z} qz FROM q) t),
 jr AS (SELECT ry.*, fid, x1-x0 ax, y1-y0 ay, z1-z0 az, x2-x0 bx, y2-y0 by_, z2-z0 bz, qx-x0 sx, qy-y0 sy, qz-z0 sz FROM ry, k),
 mt AS (SELECT *, uy*bz-uz*by_ hx, uz*bx-ux*bz hy, ux*by_-uy*bx hz, sy*az-sz*ay ox, sz*ax-sx*az oy, sx*ay-sy*ax oz FROM jr),
 dt AS (SELECT *, ax*hx+ay*hy+az*hz de FROM mt),
 th AS (SELECT *, (sx*hx+sy*hy+sz*hz)/de f, (ux*ox+uy*oy+uz*oz)/de g, (bx*ox+by_*oy+bz*oz)/de t FROM dt WHERE abs(de) > 1e-12)
 SELECT qid, round(min(t),6)+0.0 t, round(arg_min(qx+t*ux, t),5)+0.0 x, round(arg_min(qy+t*uy, t),5)+0.0 y, round(arg_min(qz+t*uz, t),5)+0.0 z FROM th WHERE f>=0 AND g>=0 AND f+g<=1 AND t>=0 GROUP BY qid"""


def _hits(rays, mesh):
    return spatial.ray_cast(rays, mesh).select("qid", r("t").alias("t"), *[r(a, 5).alias(a) for a in "xyz"])


@query(_RAYS.format(z="0.0", ux="0.0", uy="0.0", uz="1.0"))
def ray_cast_all(spark, d):
    rays = X.all_probes(spark, d).select("qid", "x", "y", F.lit(0.0).alias("z"), F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(1.0).alias("uz"))
    return _hits(rays, X.grid(spark, d))


@query(_RAYS.format(z="qz - 40", ux="(qid % 7 - 3) / 4.0", uy="(qid % 5 - 2) / 8.0", uz="(qid % 3 + 1) / 2.0"))
def ray_cast_oblique(spark, d):
    """Rays of 105 directions, most of them slanting, from all probes."""
    u = [((F.col("qid") % 7 - 3) / 4.0).alias("ux"), ((F.col("qid") % 5 - 2) / 8.0).alias("uy"), ((F.col("qid") % 3 + 1) / 2.0).alias("uz")]
    return _hits(X.all_probes(spark, d).select("qid", "x", "y", (F.col("z") - 40).alias("z"), *u), X.grid(spark, d))


_UNEVEN = CLOUD + """, b AS (SELECT vid id, x min_x, y min_y, z min_z, x + s max_x, y + s/2 max_y, z + s/4 max_z FROM (SELECT *, CASE WHEN vid % 50 = 0 THEN 1.5 ELSE (vid % 9) / 40.0 END s FROM p) t)
 SELECT p.id a, q.id b FROM b p JOIN b q ON p.id < q.id AND p.min_x <= q.max_x AND q.min_x <= p.max_x AND p.min_y <= q.max_y AND q.min_y <= p.max_y AND p.min_z <= q.max_z AND q.min_z <= p.max_z"""


@query(_UNEVEN)
def overlapping_boxes_of_any_size(spark, d):
    """Boxes at every embedding: points, small ones, and a few across most of the others."""
    s = F.when(F.col("vid") % 50 == 0, 1.5).otherwise((F.col("vid") % 9) / 40.0)
    p = X.points(spark, d).withColumn("s", s)
    return spatial.overlapping_boxes(p.select(F.col("vid").alias("id"), *[F.col(a).alias(f"min_{a}") for a in "xyz"], *[(F.col(a) + F.col("s") / k).alias(f"max_{a}") for a, k in (("x", 1), ("y", 2), ("z", 4))]))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
