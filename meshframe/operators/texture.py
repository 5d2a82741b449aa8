"""Materials: UV tables, atlases, seams, and image helpers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import quantise
from ..schema import MeshFrame
from .topology import EDGE


def add_material(materials: DataFrame, new: DataFrame, most: int = 4096) -> DataFrame:
    """new: mesh_id, rows, cols, texture. Ids follow those there are; empty images are left
    out, larger ones are recorded at their shrunken size."""
    top = materials.groupBy("mesh_id").agg(F.max("mid").alias("_t"))
    n = new.where("rows > 0 and cols > 0").join(top, "mesh_id", "left")
    n = n.withColumn("mid", F.coalesce("_t", F.lit(-1)) + F.row_number().over(Window.partitionBy("mesh_id").orderBy("rows", "cols", F.xxhash64("texture"))))
    return materials.unionByName(shrunken(n, most).select("mesh_id", "mid", "rows", "cols", "texture"))


def shrunken(images: DataFrame, most: int) -> DataFrame:
    """Sizes after a shrink to at most ``most`` on the longer side, the aspect kept."""
    s = F.least(F.lit(1.0), most / F.greatest("rows", "cols"))
    return images.withColumns({"rows": F.greatest(F.round(F.col("rows") * s), F.lit(1)).cast("int"), "cols": F.greatest(F.round(F.col("cols") * s), F.lit(1)).cast("int")})


def remove_materials(mesh: MeshFrame, ids: DataFrame | None = None) -> MeshFrame:
    """Without some materials (all by default) and everything of theirs."""
    out = {}
    for name in ("materials", "uvs", "face_uvs"):
        table = getattr(mesh, name)
        if table is not None:
            out[name] = table.limit(0) if ids is None else table.join(ids.select("mesh_id", "mid").distinct(), ["mesh_id", "mid"], "left_anti")
    return mesh.with_(**out)


def copy_materials(materials: DataFrame, other: DataFrame) -> DataFrame:
    """Another mesh's materials under their own ids; they take the place of materials that
    have these ids already."""
    kept = materials.join(other.select("mesh_id", "mid").distinct(), ["mesh_id", "mid"], "left_anti")
    return kept.select(*materials.columns).unionByName(other.select(*materials.columns))


def corner_uvs(mesh: MeshFrame) -> DataFrame:
    """The UVs of textured corners: mesh_id, mid, fid, slot, vid, u, v."""
    ids = mesh.face_uvs.select("mesh_id", "mid", "fid", F.posexplode(F.array("uv0", "uv1", "uv2")).alias("slot", "uvid"))
    at = mesh.faces.select("mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("slot", "vid"))
    return ids.join(mesh.uvs, ["mesh_id", "mid", "uvid"]).join(at, ["mesh_id", "fid", "slot"]).select("mesh_id", "mid", "fid", "slot", "vid", "u", "v")


def textured(mesh: MeshFrame) -> bool:
    return mesh.uvs is not None and mesh.face_uvs is not None


def with_corner_uvs(mesh: MeshFrame, corners: DataFrame) -> MeshFrame:
    """The mesh with new UV tables, from a row per corner as ``set_face_uvs`` takes them."""
    uvs, face_uvs = set_face_uvs(corners.select("mesh_id", "mid", "fid", "slot", "u", "v"))
    return mesh.with_(uvs=uvs, face_uvs=face_uvs)


def used_uvs(mesh: MeshFrame) -> MeshFrame:
    """Without UVs of faces that are gone, and without UVs that no face has."""
    if not textured(mesh):
        return mesh
    f = mesh.face_uvs.join(mesh.faces.select("mesh_id", "fid"), ["mesh_id", "fid"], "left_semi").select(*mesh.face_uvs.columns)
    used = f.select("mesh_id", "mid", F.explode(F.array("uv0", "uv1", "uv2")).alias("uvid")).distinct()
    return mesh.with_(face_uvs=f, uvs=mesh.uvs.join(used, ["mesh_id", "mid", "uvid"], "left_semi").select(*mesh.uvs.columns))


def draped(mesh: MeshFrame, cells: DataFrame, rows: int, cols: int, texture: DataFrame) -> MeshFrame:
    """A height map under one image. cells: mesh_id, vid, i, j, the grid place of each
    vertex in a grid of rows x cols; texture: mesh_id, rows, cols, texture. All materials
    go; u runs along columns and v along rows, as fractions."""
    bare = remove_materials(mesh) if mesh.materials is not None else mesh
    image = add_material(texture.limit(0).select("mesh_id", F.lit(0).cast("bigint").alias("mid"), "rows", "cols", "texture"), texture)
    at = mesh.faces.select("mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("slot", "vid")).join(cells, ["mesh_id", "vid"])
    corners = at.select("mesh_id", F.lit(0).cast("bigint").alias("mid"), "fid", "slot", (F.col("j") / cols).alias("u"), (F.col("i") / rows).alias("v"))
    return with_corner_uvs(bare.with_(materials=image), corners)


def atlas(materials: DataFrame) -> DataFrame:
    """Where each material stands in one image of all side by side, scaled to the greatest
    height: mesh_id, mid, width, start, total."""
    tall = materials.where("rows > 0 and cols > 0").withColumn("_h", F.max("rows").over(Window.partitionBy("mesh_id")))
    wide = tall.withColumn("width", F.floor(F.col("cols") * F.col("_h") / F.col("rows")).cast("bigint"))
    before = Window.partitionBy("mesh_id").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    return wide.select("mesh_id", "mid", "width", F.coalesce(F.sum("width").over(before), F.lit(0)).alias("start"), F.sum("width").over(Window.partitionBy("mesh_id")).alias("total"))


def merged_materials(mesh: MeshFrame) -> MeshFrame:
    """All materials as one: u moves into the material's part of the atlas, v stays."""
    a = atlas(mesh.materials)
    uv = mesh.uvs.join(a, ["mesh_id", "mid"]).withColumn("u", (F.col("start") + F.col("u") * F.col("width")) / F.col("total"))
    key = ["mesh_id", "mid", "uvid"]
    numbers = uv.select(*key, (F.row_number().over(Window.partitionBy("mesh_id").orderBy("mid", "uvid")) - 1).alias("n"))
    f = mesh.face_uvs
    for k in range(3):
        f = f.join(numbers.select("mesh_id", "mid", F.col("uvid").alias(f"uv{k}"), F.col("n").alias(f"n{k}")), ["mesh_id", "mid", f"uv{k}"])
    f = f.select("mesh_id", F.lit(0).cast("bigint").alias("mid"), "fid", *[F.col(f"n{k}").alias(f"uv{k}") for k in range(3)])
    uv = uv.join(numbers, key).select("mesh_id", F.lit(0).cast("bigint").alias("mid"), F.col("n").alias("uvid"), "u", "v")
    return mesh.with_(uvs=uv, face_uvs=f)


def set_face_uvs(corner_uvs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """corner_uvs: mesh_id, mid, fid, slot, u, v. The UV table, in which equal rounded UVs
    of a material are one, and the faces' UV ids."""
    q = corner_uvs.withColumns({"qu": quantise(F.col("u")), "qv": quantise(F.col("v")), "ord": F.col("fid") * 3 + F.col("slot")})
    one = q.groupBy("mesh_id", "mid", "qu", "qv").agg(F.min(F.struct("ord", "u", "v")).alias("p")).select("mesh_id", "mid", "qu", "qv", "p.*")
    one = one.withColumn("uvid", F.row_number().over(Window.partitionBy("mesh_id", "mid").orderBy("ord")) - 1)
    f = q.join(one.select("mesh_id", "mid", "qu", "qv", "uvid"), ["mesh_id", "mid", "qu", "qv"])
    f = f.groupBy("mesh_id", "mid", "fid").agg(*[F.max(F.when(F.col("slot") == k, F.col("uvid"))).alias(f"uv{k}") for k in range(3)])
    return one.select("mesh_id", "mid", "uvid", "u", "v"), f


def texture_edges(faces: DataFrame, face_uvs: DataFrame) -> DataFrame:
    """How many different UV edges each edge has: mesh_id, u, w, n (over 1 at a seam)."""
    j = faces.join(face_uvs, ["mesh_id", "fid"])
    rows = F.array(*[F.struct(F.least(f"v{k}", f"v{(k + 1) % 3}").alias("u"), F.greatest(f"v{k}", f"v{(k + 1) % 3}").alias("w"), F.least(f"uv{k}", f"uv{(k + 1) % 3}").alias("s"), F.greatest(f"uv{k}", f"uv{(k + 1) % 3}").alias("t")) for k in range(3)])
    return j.select("mesh_id", "mid", F.explode(rows).alias("r")).select("mesh_id", "mid", "r.*").groupBy(*EDGE).agg(F.countDistinct("mid", "s", "t").alias("n"))


def face_materials(faces: DataFrame, face_uvs: DataFrame) -> DataFrame:
    """The material of each face, -1 without one."""
    return faces.select("mesh_id", "fid").join(face_uvs.select("mesh_id", "fid", "mid"), ["mesh_id", "fid"], "left").select("mesh_id", "fid", F.coalesce("mid", F.lit(-1)).alias("mid"))


def unused_uvs(uvs: DataFrame, face_uvs: DataFrame) -> DataFrame:
    """UVs that no face has."""
    used = face_uvs.select("mesh_id", "mid", F.explode(F.array("uv0", "uv1", "uv2")).alias("uvid")).distinct()
    return uvs.join(used, ["mesh_id", "mid", "uvid"], "left_anti")


def move_uvs(uvs: DataFrame, updates: DataFrame) -> DataFrame:
    """updates: mesh_id, mid, uvid, u, v."""
    n = updates.select("mesh_id", "mid", "uvid", F.col("u").alias("_u"), F.col("v").alias("_v"))
    return uvs.join(n, ["mesh_id", "mid", "uvid"], "left").select("mesh_id", "mid", "uvid", F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))


def shrink(image: np.ndarray, most: int) -> np.ndarray:
    """Area resampling to at most ``most`` on the longer side."""
    rows, cols = image.shape[:2]
    s = min(1.0, most / max(rows, cols))
    if s == 1.0:
        return image.copy()
    new = max(1, round(rows * s)), max(1, round(cols * s))
    out = image.astype(float)
    for axis, n in enumerate(new):
        edges = np.linspace(0, out.shape[axis], n + 1)
        total = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)], axis)
        low = np.minimum(edges.astype(int), out.shape[axis])
        at = total.take(low, axis) + out.take(np.minimum(low, out.shape[axis] - 1), axis) * (edges - low).reshape([-1 if k == axis else 1 for k in range(out.ndim)])
        out = np.diff(at, axis=axis) / (out.shape[axis] / n)
    return out.astype(image.dtype) if not np.issubdtype(image.dtype, np.integer) else np.rint(out).astype(image.dtype)


def side_by_side(images: Sequence[np.ndarray]) -> tuple[np.ndarray | None, list[int]]:
    """One image of all, scaled to the greatest height, and their first columns."""
    if not images or len({i.dtype for i in images}) > 1:
        return None, []
    tall = max(i.shape[0] for i in images)
    scaled = []
    for i in images:
        cols = int(i.shape[1] * tall / i.shape[0])
        r, c = np.arange(tall) * i.shape[0] // tall, np.arange(cols) * i.shape[1] // max(cols, 1)
        scaled.append(i[r][:, c])
    return np.concatenate(scaled, axis=1), np.cumsum([0, *(s.shape[1] for s in scaled[:-1])]).tolist()
