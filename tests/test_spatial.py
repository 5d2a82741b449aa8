"""Searches down the tree of boxes, and box joins, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.functions.vec import Vec
from meshframe.operators import spatial, tree
from meshframe.schema import FACES, VERTICES, MeshFrame


def cloud(kind, seed=2):
    rng = random.Random(seed)
    if kind == "even":
        return [(rng.random(), rng.random(), rng.random()) for _ in range(700)]
    if kind == "cluster":  # nine tenths in a thousandth of the space, half of those on one spot
        return [(0.5 + rng.random() * 1e-3, 0.5, 0.5 + rng.random() * 1e-3) for _ in range(350)] + [(0.5, 0.5, 0.5)] * 350 + [(rng.random() * 9, rng.random(), rng.random()) for _ in range(70)]
    if kind == "flat":
        return [(float(i), float(j), 0.0) for i in range(26) for j in range(26)]
    if kind == "ties":  # two values on the widest axis
        return [(rng.choice([0.0, 1000.0]), float(rng.randrange(5)), rng.random()) for _ in range(500)]
    return [(2.0**k, -(2.0**-k), 0.0) for k in range(40)]


@pytest.mark.parametrize("kind", ["even", "cluster", "flat", "ties", "steep"])
def test_nearest(spark, kind):
    pts = cloud(kind)
    rng = random.Random(9)
    asked = pts[::9] + [(rng.random() * 3, rng.random(), rng.random()) for _ in range(20)] + [(1e5, -1e5, 7.0), (0.5, 0.5, 0.5)]
    p = spark.createDataFrame([(k * 3, *x) for k, x in enumerate(pts)] + [(9999, float("nan"), 0.0, 0.0), (9998, None, 0.0, 0.0)], "vid long, x double, y double, z double").repartition(4)
    q = spark.createDataFrame([(k, *x) for k, x in enumerate(asked)], "qid long, x double, y double, z double")
    a, b = np.array(asked), np.array(pts)
    d2 = (a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2 + (a[:, None, 2] - b[None, :, 2]) ** 2
    for n, leaf in ((1, 16),) if kind in ("steep", "flat") else ((20, 16),) if kind == "even" else ((7, 4),):
        got = {(r["qid"], r["k"]): (r["vid"], r["d2"]) for r in spatial.nearest(q, p, n, leaf).collect()}
        assert len(got) == len(asked) * min(n, len(pts))
        for i in range(len(asked)):
            order = np.lexsort((np.arange(len(pts)), d2[i]))[:n]
            assert [got[i, k + 1] for k in range(len(order))] == [(int(j) * 3, d2[i, j]) for j in order]


def test_few_points(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0)], "vid long, x double, y double, z double")
    q = p.withColumnRenamed("vid", "qid")
    assert sorted((r["qid"], r["k"], r["vid"]) for r in spatial.nearest(q, p, 5).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]
    assert spatial.nearest(q, p.where("false")).count() == 0
    assert spatial.nearest(q.where("false"), p).count() == 0


def test_leaves_are_bounded(spark):
    for kind in ("cluster", "ties"):
        rows = [(k, *x) for k, x in enumerate(cloud(kind))]
        p = spark.createDataFrame(rows, "vid long, x double, y double, z double").dropDuplicates(["x", "y", "z"])
        t = tree.build(p, Vec.of(), Vec.of(), 20)
        sizes = t.items.groupBy("leaf").count().agg(F.max("count"), F.sum("count")).first()
        assert sizes[0] <= 20 and sizes[1] == p.count()
        assert t.items.columns == ["leaf", "vid", "x", "y", "z"]
    # items of one centre are split by a hash
    p = spark.range(500).select(F.col("id").alias("vid"), *[F.lit(1.0).alias(a) for a in "xyz"])
    assert tree.build(p, Vec.of(), Vec.of(), 40).items.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 40


def surface(spark):
    """A bumpy sheet, a face across all of it, and a needle."""
    rng = random.Random(3)
    v = [(0, i * 15 + j, float(i), float(j), rng.random()) for i in range(15) for j in range(15)]
    f = [t for i in range(14) for j in range(14) for a in [i * 15 + j] for t in ((a, a + 15, a + 1), (a + 1, a + 15, a + 16))]
    v += [(0, 1000, -50.0, -50.0, 4.0), (0, 1001, 60.0, -50.0, 4.5), (0, 1002, 5.0, 70.0, 5.0), (0, 1003, 3.0, 3.0, 2.0), (0, 1004, 3.0, 3.0, 3.0), (0, 1005, 3.001, 3.0, 2.5)]
    f += [(1000, 1001, 1002), (1003, 1004, 1005)]
    return v, f, MeshFrame(spark.createDataFrame(v, VERTICES), spark.createDataFrame([(0, k, *t) for k, t in enumerate(f)], FACES))


def probes():
    rng = random.Random(8)
    return [(rng.uniform(-2, 17), rng.uniform(-2, 17), rng.uniform(-3, 8)) for _ in range(60)] + [(3.0, 3.0, 2.4), (500.0, 3.0, -9.0), (0.0, 0.0, 0.0)]


def closest(p, a, b, c):
    """By trying the inside and each edge."""
    n = np.cross(b - a, c - a)
    q = p - n * np.dot(p - a, n) / np.dot(n, n)
    if all(np.dot(np.cross(t - s, q - s), n) >= 0 for s, t in ((a, b), (b, c), (c, a))):
        return q
    spots = [s + (t - s) * min(1, max(0, np.dot(p - s, t - s) / np.dot(t - s, t - s))) for s, t in ((a, b), (b, c), (c, a))]
    return min(spots, key=lambda x: np.sum((p - x) ** 2))


@pytest.mark.parametrize("leaf", [7])
def test_closest_surface_point(spark, leaf):
    v, f, mesh = surface(spark)
    at = {r[1]: np.array(r[2:]) for r in v}
    q = spark.createDataFrame([(k, *x) for k, x in enumerate(probes())], "qid long, x double, y double, z double")
    got = {r["qid"]: r for r in spatial.closest_surface_point(q, mesh, leaf).collect()}
    for k, x in enumerate(probes()):
        spots = [closest(np.array(x), *(at[i] for i in t)) for t in f]
        d2 = min(np.sum((np.array(x) - s) ** 2) for s in spots)
        r = got[k]
        assert r["d2"] == pytest.approx(d2, abs=1e-9)
        assert np.allclose(closest(np.array(x), *(at[i] for i in f[r["fid"]])), [r["x"], r["y"], r["z"]], atol=1e-7)


@pytest.mark.parametrize("leaf", [7])
def test_rays(spark, leaf):
    v, f, mesh = surface(spark)
    at = {r[1]: np.array(r[2:]) for r in v}
    rng = random.Random(6)
    rays = [(k, *x, *rng.choice([(0.0, 0.0, 1.0), (0.0, 0.0, -2.0), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1))])) for k, x in enumerate(probes())]
    df = spark.createDataFrame(rays, "qid long, x double, y double, z double, ux double, uy double, uz double")
    got = {r["qid"]: (r["t"], r["x"], r["y"], r["z"]) for r in spatial.ray_cast(df, mesh, leaf).collect()}
    want = {}
    for k, *x in rays:
        o, u = np.array(x[:3]), np.array(x[3:])
        for t in f:
            a, b, c = (at[i] for i in t)
            m = np.array([b - a, c - a, -u]).T
            if abs(np.linalg.det(m)) > 1e-12:
                s = np.linalg.solve(m, o - a)
                if s[0] >= 0 and s[1] >= 0 and s[0] + s[1] <= 1 and s[2] >= 0 and s[2] < want.get(k, (np.inf,))[0]:
                    want[k] = (s[2], *(o + u * s[2]))
    assert set(got) == set(want) and len(want) > 20
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-7)


def test_boxes_of_any_size(spark):
    rng = random.Random(5)
    rows = []
    for k in range(200):
        s = rng.choice([0.0, 1e-6, 0.3, 5.0, 1e4]) if k % 40 else 1e9
        low = [rng.uniform(-20, 20) for _ in range(3)]
        rows.append((k, *low, *(x + s * rng.random() for x in low)))
    rows += [(300, *rows[7][1:]), (301, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (302, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0), (303, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    b = spark.createDataFrame(rows, "id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    got = sorted((r["a"], r["b"]) for r in spatial.overlapping_boxes(b).collect())
    meets = lambda p, q: all(p[i] <= q[i + 3] and q[i] <= p[i + 3] for i in (1, 2, 3))
    assert got == sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and meets(p, q))
    assert spatial.overlapping_boxes(b.where("false")).count() == 0
    assert spatial.overlapping_boxes(b.where("max_x - min_x < 0 or id in (301, 302)")).count() == 1
