"""Vector algebra as Column expressions; Catalyst folds and compiles them.

A ``Vec`` is three Columns. Nothing here is a UDF.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class Vec:
    """Three Columns with the operations of a 3-vector."""

    def __init__(self, x, y, z):
        self.x, self.y, self.z = (c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y, z))

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Vec:
        return cls(*(F.col(f"{prefix}{a}{suffix}") for a in "xyz"))

    def __iter__(self):
        return iter((self.x, self.y, self.z))

    def __add__(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def __mul__(self, s) -> Vec:
        return Vec(self.x * s, self.y * s, self.z * s)

    __rmul__ = __mul__

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm2(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm2())

    def unit(self) -> Vec:
        """Of length 1; a zero vector stays zero."""
        n = self.norm()
        return Vec(*(F.when(n > 0, c / n).otherwise(F.lit(0.0)) for c in self))

    def struct(self, *extra: Column) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"), *extra)

    def columns(self, prefix: str = "", suffix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{a}{suffix}") for c, a in zip(self, "xyz", strict=True)]


def field(c: Column) -> Vec:
    """The vector in a struct column with fields x, y, z."""
    return Vec(c["x"], c["y"], c["z"])


def quantise(c: Column, digits: int = 4) -> Column:
    """Rounding that defines vertex identity: the fraction is scaled, a half is added
    whatever its sign, and the result is cut towards zero."""
    scale = 10**digits
    whole = c.cast("bigint")
    return whole + ((c - whole) * scale + 0.5).cast("bigint") / scale


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def affine(m: Sequence[float], v: Vec) -> Vec:
    """A 4x4 row-major matrix applied to a point; entries are literals of the plan."""
    rows = [m[i : i + 4] for i in (0, 4, 8)]
    return Vec(*(v.x * float(a) + v.y * float(b) + v.z * float(c) + float(d) for a, b, c, d in rows))


def rotate(m: Sequence[float], v: Vec) -> Vec:
    """The matrix without its translation."""
    rows = [m[i : i + 3] for i in (0, 4, 8)]
    return Vec(*(v.x * float(a) + v.y * float(b) + v.z * float(c) for a, b, c in rows))


def face_vector(a: Vec, b: Vec, c: Vec) -> Vec:
    """Normal of a face, twice as long as its area."""
    return (b - a).cross(c - b)


def area(a: Vec, b: Vec, c: Vec) -> Column:
    return face_vector(a, b, c).norm() / 2


def cosine(at: Vec, a: Vec, b: Vec) -> Column:
    """Cosine of the angle at a point between two others; null where it has none."""
    u, v = a - at, b - at
    return F.try_divide(u.dot(v), u.norm() * v.norm())


def angle(u: Vec, v: Vec) -> Column:
    n = u.norm() * v.norm()
    return F.when(n > 0, F.acos(clamp(u.dot(v) / n, -1, 1)))


def project_to_plane(p: Vec, on: Vec, normal: Vec) -> Vec:
    """The nearest point of the plane through ``on``; the normal needs no length."""
    n = normal.unit()
    return p - n * (p - on).dot(n)


def signed_distance(p: Vec, on: Vec, unit_normal: Vec) -> Column:
    return (p - on).dot(unit_normal)


def reflect(v: Vec, on: Vec, unit_normal: Vec) -> Vec:
    return v + unit_normal * (2 * (on - v).dot(unit_normal))


def line_plane(p: Vec, n: Vec, x0: Vec, x1: Vec) -> Vec:
    """Where the line x0-x1 meets the plane (p, n); x0 where it runs along the plane or
    the meeting lies behind x0."""
    w = n.dot(x1 - x0)
    t = F.when(F.abs(w) > 1e-4, (w - (x1 - p).dot(n)) / w).otherwise(w)
    return x0 + (x1 - x0) * F.when(t > 1e-4, t).otherwise(F.lit(0.0))


def line_intersection(p0: Vec, p1: Vec, q0: Vec, q1: Vec) -> Vec:
    """Meeting point of two coplanar lines; null components where they are parallel."""
    u, v, w = p1 - p0, q1 - q0, q0 - p0
    uv = u.cross(v)
    t = F.try_divide(w.cross(v).dot(uv), uv.norm2())
    return p0 + u * t


def on_both_segments(x: Vec, p0: Vec, p1: Vec, q0: Vec, q1: Vec, tolerance: float = 1e-8) -> Column:
    """Is x inside the spheres about both ends of both segments that pass through the other end?"""
    tests = []
    for a, b in ((p0, p1), (q0, q1)):
        reach = (b - a).norm2() + tolerance
        tests += [(x - a).norm2() <= reach, (x - b).norm2() <= reach]
    return reduce(lambda s, t: s & t, tests)


def barycentric(p: Vec, a: Vec, b: Vec, c: Vec) -> tuple[Column, Column, Column]:
    """Signed barycentric coordinates of the projection of p; null on a degenerate face."""
    n = face_vector(a, b, c)
    d = n.norm2()
    u = F.try_divide((c - b).cross(p - b).dot(n), d)
    v = F.try_divide((a - c).cross(p - c).dot(n), d)
    return u, v, 1 - u - v


def from_barycentric(u: Column, v: Column, w: Column, a: Vec, b: Vec, c: Vec) -> Vec:
    return a * u + b * v + c * w


def inside_face(p: Vec, a: Vec, b: Vec, c: Vec, tolerance: float = 1e-9) -> Column:
    """Does the projection of p lie in the closed triangle (relative tolerance)?"""
    return F.coalesce(reduce(lambda s, t: s & t, [k >= -tolerance for k in barycentric(p, a, b, c)]), F.lit(False))


def nearest_on_segment(p: Vec, a: Vec, b: Vec) -> Vec:
    d = b - a
    t = clamp(F.coalesce(F.try_divide((p - a).dot(d), d.norm2()), F.lit(0.0)), 0, 1)
    return a + d * t


def nearest_in_face(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Closest point of the closed triangle: struct of d2, part (0 inside, 1..3 the edges
    ab, bc, ca; of equals the first) and x, y, z.

    All is told by five products of the sides from a and of the way to p, so the place is
    two shares of the sides and the vectors are put together once, at the end."""
    e, f, w = b - a, c - a, p - a
    ee, ef, ff, we, wf = e.dot(e), e.dot(f), f.dot(f), w.dot(e), w.dot(f)
    det = ee * ff - ef * ef
    u, v = F.try_divide(ff * we - ef * wf, det), F.try_divide(ee * wf - ef * we, det)
    share = lambda x, y: clamp(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 0, 1)
    ab, bc, ac = share(we, ee), share(wf - we - ef + ee, ee - 2 * ef + ff), share(wf, ff)
    # squared distance from p, less that of a from p
    edges = [
        F.struct((ab * (ab * ee - 2 * we)).alias("k"), F.lit(1).alias("part"), ab.alias("u"), F.lit(0.0).alias("v")),
        F.struct((ee - 2 * we + bc * (bc * (ee - 2 * ef + ff) - 2 * (wf - we - ef + ee))).alias("k"), F.lit(2).alias("part"), (1 - bc).alias("u"), bc.alias("v")),
        F.struct((ac * (ac * ff - 2 * wf)).alias("k"), F.lit(3).alias("part"), F.lit(0.0).alias("u"), ac.alias("v")),
    ]
    inside = F.struct(F.lit(0.0).alias("k"), F.lit(0).alias("part"), u.alias("u"), v.alias("v"))
    at = F.when((u >= 0) & (v >= 0) & (u + v <= 1), inside).otherwise(F.least(*edges))
    return F.transform(F.array(at), lambda s: _placed(p, a + e * s["u"] + f * s["v"], s["part"]))[0]


def _placed(p: Vec, q: Vec, part: Column) -> Column:
    return F.struct((p - q).norm2().alias("d2"), part.alias("part"), *q.columns())


def ray_hit(o: Vec, u: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Distance along u (in lengths of u) at which the ray from o meets the triangle, or null."""
    e1, e2 = b - a, c - a
    h = u.cross(e2)
    det = e1.dot(h)
    s = o - a
    q = s.cross(e1)
    f, g, t = (F.try_divide(k, det) for k in (s.dot(h), u.dot(q), e2.dot(q)))
    return F.when((F.abs(det) > 1e-12) & (f >= 0) & (g >= 0) & (f + g <= 1) & (t >= 0), t)


def meeting_parameter(t0: Column, t1: Column, f0: Column, f1: Column, d: Column) -> Column:
    """Where on a segment of length d two fronts meet that leave its ends at t0 and t1 with
    slowness f0 and f1 (share from the first end; a half where both stand still)."""
    slow = d * (f0 + f1)
    return F.when(slow != 0, (t1 - t0 + f1 * d) / slow).otherwise(F.lit(0.5))


def lerp(a: Vec, b: Vec, t: Column) -> Vec:
    return a + (b - a) * t


def givens(a: Column, b: Column) -> Column:
    """Rotation that takes (a, b) to (r, 0): struct c, s, r, with c a - s b = r >= 0 and
    s a + c b = 0. (0, 0) is not turned."""
    r = F.hypot(a, b)
    c, s = F.coalesce(F.try_divide(a, r), F.lit(1.0)), F.coalesce(F.try_divide(-b, r), F.lit(0.0))
    return F.struct(c.alias("c"), (s + 0.0).alias("s"), r.alias("r"))


def front_terms(u, a, b, cos, slowness) -> tuple:
    """A planar front reached A at 0 and B at u, and goes on to C with |CB| = a, |CA| = b and
    the corner's cosine. Its time is linear, with a gradient as long as the slowness; the
    gradient from the two known times and an unknown t at C, squared by the sides' inverse
    products, gives x t^2 - 2 y t + z = 0. Numbers or Columns: x, y, z."""
    ab = a * b * cos
    return a * a + b * b - 2 * ab, u * (b * b - ab), b * b * (u * u - slowness * slowness * a * a * (1 - cos * cos))


def from_inside(t, u, a, b, cos) -> tuple:
    """Two conditions under which the gradient at C points out of the corner, so that the
    front came through the triangle. Numbers or Columns."""
    return a * t >= b * cos * (t - u), b * (t - u) >= a * cos * t


def crossing_time(tb: Column, ta: Column, a: Column, b: Column, theta: Column, slowness: Column) -> Column:
    """Arrival at corner C of a triangle: sides a = |CB| and b = |CA| with the angle theta
    between them, arrivals ta <= tb at A and B. Where the front does not come through the
    triangle it follows an edge."""
    u, cos = tb - ta, F.cos(theta)
    x, y, z = front_terms(u, a, b, cos, slowness)
    t = F.when((x > 0) & (y * y >= x * z), (y + F.sqrt(F.greatest(y * y - x * z, F.lit(0.0)))) / x)
    p, q = from_inside(t, u, a, b, cos)
    edge = F.least(slowness * b + ta, slowness * a + tb)
    return F.when(F.coalesce(p & q & (t > u), F.lit(False)), t + ta).otherwise(edge)


def sorted3(a: Column, b: Column, c: Column) -> Column:
    return F.array_sort(F.array(a, b, c))


def box6(a: Vec, b: Vec) -> list[Column]:
    """Least and greatest of each axis of two corners, interleaved."""
    return [f(p, q) for p, q in zip(a, b, strict=True) for f in (F.least, F.greatest)]


def register_sql(spark: SparkSession) -> None:
    """The scalar helpers as SQL functions of this session."""
    v3 = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>"
    for name, args, kind, body in (
        ("vec_dot", f"a {v3}, b {v3}", "DOUBLE", "a.x*b.x + a.y*b.y + a.z*b.z"),
        ("vec_cross", f"a {v3}, b {v3}", v3, "named_struct('x', a.y*b.z-a.z*b.y, 'y', a.z*b.x-a.x*b.z, 'z', a.x*b.y-a.y*b.x)"),
        ("vec_norm", f"a {v3}", "DOUBLE", "sqrt(a.x*a.x + a.y*a.y + a.z*a.z)"),
        ("tri_area", f"a {v3}, b {v3}, c {v3}", "DOUBLE", "vec_norm(vec_cross(named_struct('x', b.x-a.x, 'y', b.y-a.y, 'z', b.z-a.z), named_struct('x', c.x-b.x, 'y', c.y-b.y, 'z', c.z-b.z)))/2"),
        ("vertex_round", "v DOUBLE", "DOUBLE", "CAST(v AS BIGINT) + CAST((v - CAST(v AS BIGINT))*10000 + 0.5 AS BIGINT)/10000"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
