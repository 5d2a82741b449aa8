"""Eigenvalues of small symmetric matrices and fits of point sets, as Column expressions.

A table of a million matrices is solved where its rows are: nothing goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import Vec


def symmetric_eigen(m: Column, n: int, sweeps: int = 10) -> Column:
    """m: the n x n entries, row by row. A struct of values, by size, the largest first, and
    vectors, an array each, of length 1. Null entries give nulls.

    Cyclic rotations: each turns one pair of axes so that their product becomes 0; a sweep
    turns every pair once, and a handful of sweeps leaves nothing beside the diagonal."""
    pairs = [(p, q) for p in range(n) for q in range(p + 1, n)]
    places = F.array(*[F.lit(k) for k in range(n * n)])
    unit = F.array(*[F.lit(float(k // n == k % n)) for k in range(n * n)])
    turns = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(sweeps)), lambda _: F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in pairs])))

    def turned(s: Column, t: Column) -> Column:
        at = lambda i, j: F.get(s["m"], i * n + j)
        off = at(t["p"], t["q"])
        half = F.try_divide(at(t["q"], t["q"]) - at(t["p"], t["p"]), 2 * off)
        tan = F.when(off == 0, 0.0).otherwise(F.when(half < 0, -1.0).otherwise(1.0) / (F.abs(half) + F.sqrt(half * half + 1)))
        tan = F.coalesce(tan, F.lit(0.0))
        bound = F.struct(t["p"].alias("p"), t["q"].alias("q"), (1 / F.sqrt(tan * tan + 1)).alias("c"), (tan / F.sqrt(tan * tan + 1)).alias("s"), s["m"].alias("m"), s["v"].alias("v"))
        return F.transform(F.array(bound), _rotated)[0]

    def columns(x: Column, r: Column) -> Column:
        """x times the rotation."""
        def entry(k: Column) -> Column:
            row, j = F.floor(k / n).cast("int") * n, k % n
            a, b = F.get(x, row + r["p"]), F.get(x, row + r["q"])
            return F.when(j == r["p"], r["c"] * a - r["s"] * b).when(j == r["q"], r["s"] * a + r["c"] * b).otherwise(F.get(x, k))

        return F.transform(places, entry)

    def rows(x: Column, r: Column) -> Column:
        """The rotation, turned round, times x."""
        def entry(k: Column) -> Column:
            i, j = F.floor(k / n).cast("int"), k % n
            a, b = F.get(x, r["p"] * n + j), F.get(x, r["q"] * n + j)
            return F.when(i == r["p"], r["c"] * a - r["s"] * b).when(i == r["q"], r["s"] * a + r["c"] * b).otherwise(F.get(x, k))

        return F.transform(places, entry)

    def _rotated(r: Column) -> Column:
        half = F.struct(columns(r["m"], r).alias("m"), columns(r["v"], r).alias("v"))
        return F.transform(F.array(half), lambda h: F.struct(rows(h["m"], r).alias("m"), h["v"].alias("v")))[0]

    start = F.struct(m.alias("m"), unit.alias("v"))
    done = F.aggregate(turns, start, turned)
    each = lambda s: F.transform(F.array(*[F.lit(k) for k in range(n)]), lambda k: F.struct((-F.abs(F.get(s["m"], k * n + k))).alias("size"), k.alias("k"), F.get(s["m"], k * n + k).alias("value"), F.transform(F.array(*[F.lit(i) for i in range(n)]), lambda i: F.get(s["v"], i * n + k)).alias("vector")))
    sorted_ = F.transform(F.array(done), lambda s: F.array_sort(each(s)))[0]
    return F.struct(F.transform(sorted_, lambda x: x["value"]).alias("values"), F.transform(sorted_, lambda x: x["vector"]).alias("vectors"))


def best_rotation(c: dict[str, Column]) -> Column:
    """c: sums of products of centred positions, source by target ("xx", "xy", ..). The
    rotation (9 entries, row by row) that takes the source nearest to the target: the
    quaternion that is the largest axis of a 4 x 4 form of the sums. Never a reflection."""
    xx, xy, xz, yx, yy, yz, zx, zy, zz = (c[a + b] for a in "xyz" for b in "xyz")
    form = [
        [xx + yy + zz, yz - zy, zx - xz, xy - yx],
        [yz - zy, xx - yy - zz, xy + yx, zx + xz],
        [zx - xz, xy + yx, yy - xx - zz, yz + zy],
        [xy - yx, zx + xz, yz + zy, zz - xx - yy],
    ]
    # the largest, not the longest: the diagonal is raised until no value is negative
    up = F.sqrt(sum((x * x for row in form for x in row), F.lit(0.0)))
    m = F.array(*[form[i][j] + (up if i == j else 0.0) for i in range(4) for j in range(4)])

    def rotation(q: Column) -> Column:
        w, x, y, z = (F.get(q, F.lit(k)) for k in range(4))
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
        )

    return F.transform(F.array(symmetric_eigen(m, 4)["vectors"][0]), rotation)[0]


def turned_by(rotation: Column, v: Vec) -> Vec:
    """A rotation of 9 entries applied to a vector."""
    return Vec(*(sum((F.get(rotation, F.lit(3 * i + j)) * c for j, c in enumerate(v)), F.lit(0.0)) for i in range(3)))
