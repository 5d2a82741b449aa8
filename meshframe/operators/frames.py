"""Transforms, orientations, cameras and registration.

Matrices live on the driver and become literals of a plan."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.eigen import best_rotation, turned_by
from ..functions.vec import Vec
from ..schema import MeshFrame
from .edit import transformed
from .measure import vertex_normals
from .spatial import nearest


def _unit(v) -> np.ndarray:
    v = np.asarray(v, dtype=float)
    n = np.linalg.norm(v)
    return v / n if n else v


@dataclass(frozen=True)
class Transform:
    """A homogeneous 4x4 matrix."""

    matrix: np.ndarray = field(default_factory=lambda: np.eye(4))

    @classmethod
    def translation(cls, t) -> Transform:
        m = np.eye(4)
        m[:3, 3] = t
        return cls(m)

    @classmethod
    def rotation(cls, r, t=(0, 0, 0)) -> Transform:
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = r, t
        return cls(m)

    @classmethod
    def axes(cls, z, y, t=(0, 0, 0)) -> Transform:
        """Z along ``z``, Y as near to ``y`` as a right angle allows."""
        z = _unit(z)
        x = _unit(np.cross(y, z))
        return cls.rotation(np.stack([x, np.cross(z, x), z], axis=1), t)

    @classmethod
    def angle_axis(cls, radians: float, axis, t=(0, 0, 0)) -> Transform:
        k = _unit(axis)
        c = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        return cls.rotation(np.eye(3) + math.sin(radians) * c + (1 - math.cos(radians)) * (c @ c), t)

    def then(self, other: Transform) -> Transform:
        """This one first, the other after it."""
        return Transform(other.matrix @ self.matrix)

    __mul__ = then

    def after_translation(self, t) -> Transform:
        return Transform(self.matrix @ Transform.translation(t).matrix)

    def inverse(self) -> Transform:
        return Transform(np.linalg.inv(self.matrix))

    def is_identity(self, precision: float = 1e-4) -> bool:
        """Does it move nothing, to this precision? Positions that it was applied to are final."""
        return bool(np.abs(self.matrix - np.eye(4)).max() <= precision)

    def entries(self) -> list[float]:
        return [float(a) for a in self.matrix.ravel()]

    def point(self, p) -> np.ndarray:
        return self.matrix[:3, :3] @ np.asarray(p, float) + self.matrix[:3, 3]

    def direction(self, d) -> np.ndarray:
        return self.matrix[:3, :3] @ np.asarray(d, float)

    def apply(self, vertices: DataFrame) -> DataFrame:
        return transformed(vertices, self.entries())


def _text(v) -> str:
    return " ".join(f"{float(a):g}" for a in v)


def put_vertex(tree: dict, v) -> dict:
    """The record with values under x, y and z."""
    return tree | dict(zip("xyz", map(float, v), strict=True))


def add_vertex(trees: list[dict], v) -> list[dict]:
    """A list of records with one more, of a vertex."""
    return [*trees, put_vertex({}, v)]


def put_named(tree: dict, name: str, v) -> dict:
    """The record with a child of that name, of a vertex."""
    return tree | {name: put_vertex({}, v)}


def vertex_of(tree: dict) -> tuple[float, float, float]:
    return tuple(float(tree[a]) for a in "xyz")


def named_vertex(tree: dict, name: str) -> tuple[float, float, float] | None:
    """The vertex of a child, None without one."""
    child = tree.get(name)
    return vertex_of(child) if isinstance(child, dict) and all(a in child for a in "xyz") else None


@dataclass(frozen=True)
class Orientation:
    """A normal and an up vector, both of length 1."""

    normal: tuple = (0.0, 0.0, 1.0)
    up: tuple = (0.0, 1.0, 0.0)

    def rotated(self, t: Transform) -> Orientation:
        return Orientation(tuple(_unit(t.direction(self.normal))), tuple(_unit(t.direction(self.up))))

    def matrix(self, t=(0, 0, 0)) -> np.ndarray:
        return Transform.axes(self.normal, self.up, t).matrix

    @classmethod
    def of(cls, m: np.ndarray) -> Orientation:
        return cls(tuple(_unit(m[:3, 2])), tuple(_unit(m[:3, 1])))

    def to_tree(self) -> dict:
        return {k: put_vertex({}, v) for k, v in (("normal", self.normal), ("up", self.up))}

    def __str__(self) -> str:
        return f"normal {_text(self.normal)}; up {_text(self.up)}"

    @classmethod
    def from_tree(cls, tree: dict) -> Orientation | None:
        """None where a vector is absent."""
        have = [named_vertex(tree, k) for k in ("normal", "up")]
        return None if None in have else cls(*have)


@dataclass(frozen=True)
class Camera:
    """Position, focus, up vector, and the vertical field of view in degrees, or a parallel
    scale where that is over 0."""

    pos: tuple = (0.0, 0.0, 1.0)
    focus: tuple = (0.0, 0.0, 0.0)
    up: tuple = (0.0, 1.0, 0.0)
    fov: float = 30.0
    parallel_scale: float = 0.0

    def __post_init__(self):
        object.__setattr__(self, "fov", min(max(self.fov, 1e-3), 180 - 1e-3))
        object.__setattr__(self, "parallel_scale", min(max(self.parallel_scale, 0.0), 1.0))
        if np.linalg.norm(np.cross(np.subtract(self.focus, self.pos), self.up)) < 1e-12:
            raise ValueError("the view runs along the up vector")

    def to_tree(self) -> dict:
        tree = {k: put_vertex({}, getattr(self, k)) for k in ("pos", "focus", "up")}
        return tree | {"fov": float(self.fov), "parallel_scale": float(self.parallel_scale)}

    @classmethod
    def from_tree(cls, tree: dict) -> Camera | None:
        """None where a vector or a number is absent."""
        have = {k: named_vertex(tree, k) for k in ("pos", "focus", "up")} | {k: tree.get(k) for k in ("fov", "parallel_scale")}
        return None if None in have.values() else cls(**have)

    def __str__(self) -> str:
        return f"position {_text(self.pos)}; focus {_text(self.focus)}; up {_text(self.up)}; field of view {self.fov:g}; parallel scale {self.parallel_scale:g}"

    def axes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Right, up and view direction, all of length 1."""
        d = _unit(np.subtract(self.focus, self.pos))
        r = _unit(np.cross(d, self.up))
        return r, np.cross(r, d), d

    def distance(self, to=None) -> float:
        return float(np.linalg.norm(np.subtract(self.focus if to is None else to, self.pos)))

    def with_view_radius(self, radius: float) -> Camera:
        """A field of view that holds a sphere of this radius about the focus."""
        return replace(self, fov=2 * math.degrees(math.asin(min(1.0, radius / self.distance()))))

    def orbit(self, degrees: float) -> Camera:
        return self._turn(degrees, self.axes()[1])

    def tilt(self, degrees: float) -> Camera:
        return self._turn(degrees, self.axes()[0])

    def _turn(self, degrees: float, axis) -> Camera:
        t = Transform.angle_axis(math.radians(degrees), axis)
        return replace(self, pos=tuple(np.add(self.focus, t.direction(np.subtract(self.pos, self.focus)))), up=tuple(t.direction(self.up)))

    def focal(self) -> float:
        return 0.5 / math.tan(math.radians(self.fov) / 2)

    def project(self, p: Vec) -> tuple[Column, Column]:
        """Where points appear, from (0, 0) at the top left to (1, 1); null behind the camera."""
        r, u, d = (Vec(*map(float, a)) for a in self.axes())
        v = p - Vec(*map(float, self.pos))
        depth, f = v.dot(d), self.focal()
        x = F.when(depth > 0, v.dot(r) * f / depth + 0.5)
        y = F.when(depth > 0, 0.5 - v.dot(u) * f / depth)
        return x, y

    def unproject(self, x: float, y: float, depth: float) -> np.ndarray:
        r, u, d = self.axes()
        f = self.focal()
        return np.asarray(self.pos) + d * depth + r * ((x - 0.5) * depth / f) + u * ((0.5 - y) * depth / f)


def pair_sums(source: DataFrame, target: DataFrame, weight: Column | None = None) -> DataFrame:
    """Sums over vertices of one id: n, both centroids and the 9 products of centred
    positions, as one row. Partial sums combine before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    j = source.select("mesh_id", "vid", *Vec.of().columns("s")).join(target.select("mesh_id", "vid", *Vec.of().columns("t")), ["mesh_id", "vid"]).withColumn("w", w)
    sums = [F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col(p + a)).alias(p + a) for p in "st" for a in "xyz"], *[F.sum(F.col("w") * F.col(f"s{a}") * F.col(f"t{b}")).alias(f"p{a}{b}") for a in "xyz" for b in "xyz"], F.sum(F.col("w") * Vec.of("s").norm2()).alias("ss")]
    return j.agg(*sums)


def procrustes(source: DataFrame, target: DataFrame, scale: bool = True, weight: Column | None = None) -> Transform:
    """The similarity that takes source to target with the least squares; no reflection. No
    common vertices: nothing moves."""
    r = pair_sums(source, target, weight).first()
    n = r["n"]
    if not n:
        return Transform()
    s, t = (np.array([r[p + a] for a in "xyz"]) / n for p in "st")
    c = np.array([[r[f"p{a}{b}"] for b in "xyz"] for a in "xyz"]) / n - np.outer(s, t)
    u, d, vt = np.linalg.svd(c)
    flip = np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1])
    rot = vt.T @ flip @ u.T
    k = float((d * np.diag(flip)).sum() / (r["ss"] / n - s @ s)) if scale else 1.0
    return Transform.rotation(k * rot, t - k * rot @ s)


def procrustes_each(source: DataFrame, target: DataFrame, scale: bool = True, weight: Column | None = None) -> DataFrame:
    """The fit of ``procrustes`` for every mesh_id on its own: mesh_id, n, rotation (9
    entries), size, tx, ty, tz. Sums and solutions are Columns, so a table of a million
    meshes is fitted in one aggregate. Meshes without common vertices give no row; a mesh
    on one spot is moved only."""
    w = F.lit(1.0) if weight is None else weight
    j = source.select("mesh_id", "vid", *Vec.of().columns("s")).join(target.select("mesh_id", "vid", *Vec.of().columns("t")), ["mesh_id", "vid"]).withColumn("w", w)
    mean = [(F.sum(F.col("w") * F.col(p + a)) / F.sum("w")).alias(f"m{p}{a}") for p in "st" for a in "xyz"]
    product = [(F.sum(F.col("w") * F.col(f"s{a}") * F.col(f"t{b}")) / F.sum("w")).alias(f"p{a}{b}") for a in "xyz" for b in "xyz"]
    sums = j.groupBy("mesh_id").agg(F.sum("w").alias("n"), *mean, *product, (F.sum(F.col("w") * Vec.of("s").norm2()) / F.sum("w")).alias("ss")).where("n > 0")
    c = {a + b: F.col(f"p{a}{b}") - F.col(f"ms{a}") * F.col(f"mt{b}") for a in "xyz" for b in "xyz"}
    spread = F.col("ss") - Vec.of("ms").norm2()
    sums = sums.select("*", F.inline(F.array(F.struct(best_rotation(c).alias("rotation"), spread.alias("spread")))))
    fitted = sum((F.get("rotation", F.lit(3 * i + k)) * c[b + a] for i, a in enumerate("xyz") for k, b in enumerate("xyz")), F.lit(0.0))
    size = F.when(F.col("spread") > 0, fitted / F.col("spread")).otherwise(F.lit(1.0)) if scale else F.lit(1.0)
    out = sums.withColumn("size", size)
    moved = turned_by(F.col("rotation"), Vec.of("ms")) * F.col("size")
    return out.select("mesh_id", "n", "rotation", "size", *(Vec.of("mt") - moved).columns("t"))


def fitted(vertices: DataFrame, fits: DataFrame) -> DataFrame:
    """vertices with the fit of their mesh (from ``procrustes_each``) applied; those of meshes
    without one stay."""
    f = fits.select("mesh_id", "rotation", "size", *Vec.of("t").columns("_t"))
    v = turned_by(F.col("rotation"), Vec.of()) * F.col("size") + Vec.of("_t")
    out = vertices.join(f, "mesh_id", "left").withColumns({f"_{a}": F.coalesce(c, F.col(a)) for a, c in zip("xyz", v, strict=True)})
    return out.select(*[F.col(f"_{c}").alias(c) if c in ("x", "y", "z") else F.col(f"`{c}`") for c in vertices.columns])


def icp(source: DataFrame, target: MeshFrame, rounds: int = 10) -> Transform:
    """Point-to-plane registration: each round every source vertex meets its nearest target
    vertex, and 27 sums give the small motion that brings them onto the tangent planes."""
    normals = vertex_normals(target).select("vid", "x", "y", "z", "nx", "ny", "nz")
    total = Transform()
    for _ in range(rounds):
        now = total.apply(source.select("mesh_id", "vid", "x", "y", "z"))
        pairs = nearest(now.select(F.col("vid").alias("qid"), "x", "y", "z"), target.vertices)
        j = pairs.join(now.select(F.col("vid").alias("qid"), *Vec.of().columns("p")), "qid").join(normals, "vid")
        p, n = Vec.of("p"), Vec.of("n")
        row = [*p.cross(n), *n]
        gap = (Vec.of() - p).dot(n)
        sums = [F.sum(row[a] * row[b]) for a in range(6) for b in range(a, 6)] + [F.sum(c * gap) for c in row]
        got = j.agg(*sums).first()
        m = np.zeros((6, 6))
        m[np.triu_indices(6)] = got[:21]
        m = m + np.triu(m, 1).T
        x = np.linalg.lstsq(m, np.array(got[21:], float), rcond=None)[0]
        angle = np.linalg.norm(x[:3])
        total = total.then(Transform.angle_axis(angle, x[:3] if angle else (0, 0, 1), x[3:]))
        if np.abs(x).max() < 1e-10:
            break
    return total
