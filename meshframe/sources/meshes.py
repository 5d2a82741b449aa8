"""Where meshes come from: clouds, triangle soups, height maps, text, unions, subsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vec import Vec, area, quantise
from ..schema import MeshFrame


def _numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy("mesh_id").orderBy(*order)) - 1).cast("bigint"))


def keys(digits: int = 4) -> list[Column]:
    """The identity of a vertex: its position, each coordinate rounded."""
    return [quantise(F.col(c), digits).alias(f"q{c}") for c in "xyz"]


def cloud(points: DataFrame) -> DataFrame:
    """points: mesh_id, ord, x, y, z. Vertices with ids in order of first appearance:
    rows with NaN or null go, rows with one rounded position become one vertex with the
    position that came first. The aggregate combines before its shuffle."""
    sound = points.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z")) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    first = F.min(F.struct("ord", "x", "y", "z")).alias("p")
    merged = sound.groupBy("mesh_id", *keys()).agg(first).select("mesh_id", "qx", "qy", "qz", "p.*")
    return _numbered(merged, "vid", "ord", "x", "y", "z").select("mesh_id", "vid", "x", "y", "z")


def valid_faces(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with three different, existing vertices and an area, one (of the least fid)
    for each set of vertices."""
    f = faces.where((F.col("v0") != F.col("v1")) & (F.col("v1") != F.col("v2")) & (F.col("v2") != F.col("v0")))
    f = f.withColumn("_key", F.array_sort(F.array("v0", "v1", "v2")))
    one = f.groupBy("mesh_id", "_key").agg(F.min_by(F.struct("fid", "v0", "v1", "v2"), "fid").alias("f")).select("mesh_id", "f.*")
    return corners(vertices, one).where(area(*corner_vecs()) > 0).select("mesh_id", "fid", "v0", "v1", "v2")


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the positions of their corners: x0, y0, z0, x1, ..."""
    out = faces
    for k in range(3):
        v = vertices.select("mesh_id", F.col("vid").alias(f"v{k}"), *Vec.of().columns(suffix=str(k)))
        out = out.join(v, ["mesh_id", f"v{k}"])
    return out


def corner_vecs() -> tuple[Vec, Vec, Vec]:
    return tuple(Vec.of(suffix=str(k)) for k in range(3))


def soup(triangles: DataFrame) -> MeshFrame:
    """triangles: mesh_id, fid, x0..z2. Corners become shared vertices."""
    points = triangles.select("mesh_id", "fid", F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), *Vec.of(suffix=str(k)).columns()) for k in range(3)])).alias("c")).select("mesh_id", "fid", "c.*")
    points = points.withColumn("ord", F.col("fid") * 3 + F.col("slot"))
    vertices = cloud(points)
    slots = points.select("mesh_id", "fid", "slot", *keys()).join(vertices.select("mesh_id", "vid", *keys()), ["mesh_id", "qx", "qy", "qz"])
    faces = slots.groupBy("mesh_id", "fid").agg(*[F.max(F.when(F.col("slot") == k, F.col("vid"))).alias(f"v{k}") for k in range(3)])
    return MeshFrame(vertices, valid_faces(vertices, faces))


def height_map(grid: DataFrame, mesh_id: int = 0, stride: int = 1000, winding: str = "reference") -> MeshFrame:
    """grid: i, j, z. A vertex for each cell (x = j, y = i) and two triangles for each cell
    whose neighbours below and beside exist. ``winding``: 'reference' lets the two
    triangles of a cell face opposite sides, 'consistent' the same side."""
    v = grid.select(F.lit(mesh_id).cast("bigint").alias("mesh_id"), (F.col("i") * stride + F.col("j")).cast("bigint").alias("vid"), F.col("j").cast("double").alias("x"), F.col("i").cast("double").alias("y"), F.col("z").cast("double").alias("z"))
    at = grid.select("i", "j", (F.col("i") * stride + F.col("j")).cast("bigint").alias("vid"))
    near = lambda di, dj, name: at.select((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.col("vid").alias(name))
    diag = at.join(near(1, 1, "c"), ["i", "j"])
    left = diag.join(near(0, 1, "b"), ["i", "j"]).select((2 * F.col("vid")).alias("fid"), F.col("vid").alias("v0"), F.col("b").alias("v1"), F.col("c").alias("v2"))
    up = diag.join(near(1, 0, "b"), ["i", "j"])
    swap = winding == "consistent"
    up = up.select((2 * F.col("vid") + 1).alias("fid"), F.col("vid").alias("v0"), F.col("c" if swap else "b").alias("v1"), F.col("b" if swap else "c").alias("v2"))
    return MeshFrame(v, left.unionByName(up).select(F.lit(mesh_id).cast("bigint").alias("mesh_id"), "fid", "v0", "v1", "v2"))


def function_grid(spark: SparkSession, rows: int, cols: int, z: Callable[[Column, Column], Column] | None = None, offset=(0.0, 0.0), size=(1.0, 1.0)) -> DataFrame:
    """A grid (i, j, x, y, z) of a function of x and y (0 by default) about an offset."""
    n = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("i"), (F.col("id") % cols).cast("int").alias("j"))
    n = n.withColumn("x", (F.col("j") - cols / 2) * (size[0] / cols) + offset[0]).withColumn("y", (F.col("i") - rows / 2) * (size[1] / rows) + offset[1])
    return n.withColumn("z", z(F.col("x"), F.col("y")) if z else F.lit(0.0))


def texture_grid(grid: DataFrame, rows: int, cols: int) -> DataFrame:
    """UVs of a draped image: u along columns, v along rows."""
    return grid.select("i", "j", (F.col("j") / cols).alias("u"), (F.col("i") / rows).alias("v"))


def set_faces(vertices: DataFrame, faces: DataFrame) -> MeshFrame:
    """Connects a cloud."""
    return MeshFrame(vertices, valid_faces(vertices, faces))


def vertex_subset(mesh: MeshFrame, ids: DataFrame) -> DataFrame:
    """A cloud of some vertices, with new ids."""
    some = mesh.vertices.join(ids.select("mesh_id", "vid").distinct(), ["mesh_id", "vid"], "left_semi")
    return cloud(some.withColumnRenamed("vid", "ord"))


def used_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices that a face has."""
    ids = faces.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return vertices.join(ids, ["mesh_id", "vid"], "left_semi")


def face_subset(mesh: MeshFrame, ids: DataFrame) -> MeshFrame:
    """Some faces, and the vertices and UVs that they have; all materials stay."""
    from ..operators.texture import used_uvs

    f = mesh.faces.join(ids.select("mesh_id", "fid").distinct(), ["mesh_id", "fid"], "left_semi")
    return used_uvs(mesh.with_(vertices=used_vertices(mesh.vertices, f), faces=f))


def vertex_face_subset(mesh: MeshFrame, ids: DataFrame, hops: int = 0) -> MeshFrame:
    """Faces with all three vertices in a set; with ``hops``, faces reached from the set in
    so many steps from vertices to the faces that have them."""
    now = ids.select("mesh_id", "vid").distinct()
    flat = mesh.faces.select("mesh_id", "fid", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    if hops == 0:
        f = flat.join(now, ["mesh_id", "vid"], "left_semi").groupBy("mesh_id", "fid").count().where("count = 3")
        return face_subset(mesh, f)
    for _ in range(hops):
        touched = flat.join(now, ["mesh_id", "vid"], "left_semi").select("mesh_id", "fid").distinct()
        now = flat.join(touched, ["mesh_id", "fid"], "left_semi").select("mesh_id", "vid").distinct()
    return face_subset(mesh, touched)


def union(a: MeshFrame, b: MeshFrame) -> MeshFrame:
    """Two meshes as one: equal positions are one vertex, equal vertex sets one face. The
    second's materials take the place of the first's with the same ids, and its UVs that of
    the first's on faces that both have."""
    tag = lambda m, k: m.vertices.select("mesh_id", F.lit(k).alias("src"), "vid", "x", "y", "z")
    points = tag(a, 0).unionByName(tag(b, 1)).withColumn("ord", F.struct("src", "vid"))
    vertices = cloud(points)
    to = points.select("mesh_id", "src", F.col("vid").alias("old"), *keys()).join(vertices.select("mesh_id", "vid", *keys()), ["mesh_id", "qx", "qy", "qz"]).select("mesh_id", "src", "old", "vid")
    faces = a.faces.withColumn("src", F.lit(0)).unionByName(b.faces.withColumn("src", F.lit(1)))
    for k in range(3):
        faces = faces.join(to.withColumnsRenamed({"old": f"v{k}", "vid": f"n{k}"}), ["mesh_id", "src", f"v{k}"])
    numbered = _numbered(faces.withColumnRenamed("fid", "old"), "fid", "src", "old").select("mesh_id", "src", "old", "fid", *[F.col(f"n{k}").alias(f"v{k}") for k in range(3)])
    out = MeshFrame(vertices, valid_faces(vertices, numbered.select("mesh_id", "fid", "v0", "v1", "v2")))
    return _with_textures(out, numbered, a, b)


def _with_textures(out: MeshFrame, numbered: DataFrame, a: MeshFrame, b: MeshFrame) -> MeshFrame:
    """numbered: the faces of both meshes (src, old) with their new corners. UVs go to the
    face with the same corners, each to the slot of its vertex."""
    from ..operators import texture

    have = [(k, m) for k, m in enumerate((a, b)) if texture.textured(m)]
    kinds = [m.materials for m in (a, b) if m.materials is not None]
    if kinds:
        out = out.with_(materials=texture.copy_materials(*kinds) if len(kinds) == 2 else kinds[0])
    if not have:
        return out
    key = F.array_sort(F.array("v0", "v1", "v2")).alias("_key")
    rows = None
    for k, m in have:
        c = texture.corner_uvs(m).select("mesh_id", F.lit(k).alias("src"), F.col("fid").alias("old"), "slot", "mid", "u", "v")
        rows = c if rows is None else rows.unionByName(c)
    new = numbered.select("mesh_id", "src", "old", key, F.posexplode(F.array("v0", "v1", "v2")).alias("slot", "vid"))
    rows = rows.join(new, ["mesh_id", "src", "old", "slot"])
    first = F.max_by(F.struct("mid", "u", "v"), F.struct("src", (-F.col("old")).alias("o"))).alias("t")
    to = out.faces.select("mesh_id", "fid", key, F.posexplode(F.array("v0", "v1", "v2")).alias("slot", "vid"))
    rows = rows.groupBy("mesh_id", "_key", "vid").agg(first).join(to, ["mesh_id", "_key", "vid"])
    return texture.with_corner_uvs(out, rows.select("mesh_id", "t.mid", "fid", "slot", "t.u", "t.v"))


def repacked(mesh: MeshFrame) -> MeshFrame:
    """Vertices and faces numbered anew from 0 in order of their ids."""
    v = _numbered(mesh.vertices.withColumnRenamed("vid", "old"), "vid", "old")
    faces = mesh.faces
    for k in range(3):
        faces = faces.join(v.select("mesh_id", F.col("old").alias(f"v{k}"), F.col("vid").alias(f"n{k}")), ["mesh_id", f"v{k}"])
    faces = _numbered(faces.withColumnRenamed("fid", "old"), "fid", "old").select("mesh_id", "old", "fid", *[F.col(f"n{k}").alias(f"v{k}") for k in range(3)])
    out = mesh.with_(vertices=v.select("mesh_id", "vid", "x", "y", "z"), faces=faces.drop("old"))
    if mesh.face_uvs is None:
        return out
    moved = mesh.face_uvs.withColumnRenamed("fid", "old").join(faces.select("mesh_id", "old", "fid"), ["mesh_id", "old"])
    return out.with_(face_uvs=moved.select(*mesh.face_uvs.columns))


def faces_from_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of three vertex ids."""
    at = F.split(F.trim(F.col(column)), r"\s+")
    return lines.select(*[F.try_element_at(at, F.lit(k + 1)).cast("bigint").alias(f"v{k}") for k in range(3)])


def faces_to_text(faces: DataFrame) -> DataFrame:
    return faces.select(F.concat_ws(" ", "v0", "v1", "v2").alias("value"))


def read_obj(spark: SparkSession, path: str, mesh_id: int = 0) -> MeshFrame:
    """Vertices and triangles of one text file of v and f lines. Lines are numbered by
    file block, so ids follow the file without a single task reading it."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    at = F.split(F.trim("value"), r"\s+")
    v = lines.where("value like 'v %'").select(F.lit(mesh_id).cast("bigint").alias("mesh_id"), "n", *[at[k + 1].cast("double").alias(c) for k, c in enumerate("xyz")])
    f = lines.where("value like 'f %'").select(F.lit(mesh_id).cast("bigint").alias("mesh_id"), "n", *[(F.split(at[k + 1], "/")[0].cast("bigint") - 1).alias(f"v{k}") for k in range(3)])
    v, f = _numbered(v, "vid", "n").drop("n"), _numbered(f, "fid", "n").drop("n")
    return MeshFrame(v.select("mesh_id", "vid", "x", "y", "z"), f.select("mesh_id", "fid", "v0", "v1", "v2"))


def write_mesh(mesh: MeshFrame, path: str) -> None:
    """Parquet tables under one folder, vertices and faces clustered by mesh."""
    mesh.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    mesh.faces.write.mode("overwrite").parquet(f"{path}/faces")


def read_mesh(spark: SparkSession, path: str) -> MeshFrame:
    return MeshFrame(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/faces"))


def vertex_matrix(vertices: DataFrame) -> DataFrame:
    return vertices.select("x", "y", "z", "mesh_id", "vid").orderBy("mesh_id", "vid").select("x", "y", "z")


def face_matrix(faces: DataFrame) -> DataFrame:
    return faces.orderBy("mesh_id", "fid").select("v0", "v1", "v2")
