"""The tables of a mesh.

A bundle may hold any number of meshes; every key starts with ``mesh_id``. Vertices
and faces may carry further columns, which operators pass through where rows keep
their identity.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

VERTICES = "mesh_id bigint, vid bigint, x double, y double, z double"
FACES = "mesh_id bigint, fid bigint, v0 bigint, v1 bigint, v2 bigint"
MATERIALS = "mesh_id bigint, mid bigint, rows int, cols int, texture binary"
UVS = "mesh_id bigint, mid bigint, uvid bigint, u double, v double"
FACE_UVS = "mesh_id bigint, mid bigint, fid bigint, uv0 bigint, uv1 bigint, uv2 bigint"


@dataclass(frozen=True)
class MeshFrame:
    """Vertices and faces, and optionally materials, their UVs and the UVs of faces.

    DataFrames do not change, so a copy of a bundle is the bundle itself."""

    vertices: DataFrame
    faces: DataFrame
    materials: DataFrame | None = None
    uvs: DataFrame | None = None
    face_uvs: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> MeshFrame:
        return cls(*(spark.createDataFrame([], s) for s in (VERTICES, FACES, MATERIALS, UVS, FACE_UVS)))

    def with_(self, **tables: DataFrame) -> MeshFrame:
        return replace(self, **tables)
