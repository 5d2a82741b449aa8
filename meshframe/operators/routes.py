"""Shortest paths between pairs of vertices, directed at the goal.

Vertices are cut into cells of bounded size (the leaves of a tree of boxes). What a round
relaxes is a cell of a pair, as far as it goes inside the cell, so rounds count cells that
a path crosses, not edges. A pair's cells wait in order of cost so far plus the least that
is left: only those within a step of the least are relaxed, and a pair ends when its goal
costs no more than anything that waits. So cells behind the start or far off the straight
line are never looked at.

The least that is left is the straight distance, times the least cost per length of any
edge; with it, no cost of an edge may be negative.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import Vec
from ..plans.iterate import discard, stored
from ..schema import MeshFrame
from . import tree
from .graph import weighted_edges

#: Vertices of a cell at most.
CELL = 512
#: A round goes at least this part of a pair's straight cost beyond the least that waits.
STEPS = 16

_PAIR = ["mesh_id", "src", "dst"]
_ROWS = "mesh_id long, src long, dst long, cell long, kind int, vid long, d double, prev long, ahead double, nbr long, w double, ncell long, nahead double, goal double"
_OUT = "mesh_id long, src long, dst long, cell long, kind int, vid long, d double, prev long, ahead double"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def cells(mesh: MeshFrame, cell: int = CELL) -> DataFrame:
    """mesh_id, vid, x, y, z, cell: vertices dealt to cells by place, never more than ``cell`` each."""
    built = tree.build(mesh.vertices.select("mesh_id", "vid", *Vec.of().columns()), Vec.of(), Vec.of(), cell)
    return built.items.withColumnRenamed("leaf", "cell")


def _relax(table: pa.Table) -> pa.Table:
    """A cell of a pair. Rows of kind 0 are edges, 1 what is known, 2 what waits; out come
    vertices that are now known to be cheaper (1), and what waits in other cells (2)."""
    r = table.to_pydict()
    key = [r[c][0] for c in (*_PAIR, "cell")]
    edges: dict[int, list[tuple]] = {}
    known: dict[int, tuple[float, int]] = {}
    heap: list[tuple[float, float, int, int]] = []
    goal = min((g for g in r["goal"] if g is not None), default=float("inf"))
    for k, kind in enumerate(r["kind"]):
        prev = -1 if r["prev"][k] is None else r["prev"][k]
        if kind == 0:
            edges.setdefault(r["vid"][k], []).append((r["nbr"][k], r["w"][k], r["ncell"][k], r["nahead"][k]))
        elif kind == 1:
            known[r["vid"][k]] = min(known.get(r["vid"][k], (float("inf"), 0)), (r["d"][k], prev))
        else:
            heap.append((r["d"][k] + r["ahead"][k], r["d"][k], prev, r["vid"][k]))
    heapq.heapify(heap)
    changed: dict[int, float] = {}
    sent: dict[tuple[int, int], tuple[float, int, float]] = {}
    while heap:
        f, d, prev, v = heapq.heappop(heap)
        if f > goal or (d, prev) >= known.get(v, (float("inf"), 0)):
            continue
        cheaper = d < known.get(v, (float("inf"), 0))[0]
        known[v] = (d, prev)
        changed[v] = f - d
        if v == key[2]:
            goal = min(goal, d)
        for nbr, w, ncell, ahead in edges.get(v, ()) if cheaper else ():
            to = d + w
            if to + ahead > goal:
                continue
            if ncell == key[3]:
                if (to, v) < known.get(nbr, (float("inf"), 0)):
                    heapq.heappush(heap, (to + ahead, to, v, nbr))
            elif (to, v) < sent.get((ncell, nbr), (float("inf"), 0))[:2]:
                sent[ncell, nbr] = (to, v, ahead)
    out = [(*key, 1, v, known[v][0], None if known[v][1] < 0 else known[v][1], ahead) for v, ahead in changed.items()]
    out += [(*key[:3], c, 2, v, d, prev, ahead) for (c, v), (d, prev, ahead) in sent.items()]
    columns = zip(*out, strict=True) if out else [()] * 9
    fields = [x.split() for x in _OUT.split(", ")]
    return pa.table([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def routes(mesh: MeshFrame, pairs: DataFrame, cost: Callable[[Vec, Vec], Column] | None = None, cell: int = CELL, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """pairs: mesh_id, src, dst. The least cost over edges of each pair (mesh_id, src, dst,
    d), and what was looked at: mesh_id, src, dst, vid, d, prev (of equal costs the least
    vertex before), which ``graph.paths`` follows. Pairs that no path joins have no cost."""
    at = cells(mesh, cell)
    place = lambda v, p, *more: at.select("mesh_id", F.col("vid").alias(v), *Vec.of().columns(p), *more)
    links = weighted_edges(mesh, cost).join(place("vid", "p", "cell"), ["mesh_id", "vid"]).join(place("nbr", "n", F.col("cell").alias("ncell")), ["mesh_id", "nbr"])
    links = stored(links)
    length = (Vec.of("p") - Vec.of("n")).norm()
    scale = stored(links.groupBy("mesh_id").agg(F.coalesce(F.min(F.when(length > 0, F.col("w") / length)), F.lit(0.0)).alias("scale")))
    ends = pairs.select(*_PAIR).distinct().join(place("src", "s", F.col("cell")), ["mesh_id", "src"]).join(place("dst", "g"), ["mesh_id", "dst"]).join(scale, "mesh_id", "left")
    ends = ends.withColumn("scale", F.coalesce("scale", F.lit(0.0)) * (1 - 1e-12))
    ends = stored(ends.withColumn("h", (Vec.of("s") - Vec.of("g")).norm() * F.col("scale")))
    target = ends.select(*_PAIR, *[f"g{a}" for a in "xyz"], "scale", "h")
    waits = stored(ends.select(*_PAIR, "cell", F.col("src").alias("vid"), F.lit(0.0).alias("d"), F.lit(None).cast("long").alias("prev"), F.col("h").alias("ahead")))
    known = None  # tables of what rounds found; the least of a vertex holds
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    while True:
        found = known.where(F.col("vid") == F.col("dst")).groupBy(*_PAIR).agg(F.min("d").alias("goal")) if known is not None else ends.select(*_PAIR, none("goal", "double")).limit(0)
        first = waits.groupBy(*_PAIR).agg(F.min(F.col("d") + F.col("ahead")).alias("least"))
        bound = first.join(found, _PAIR, "left").join(target, _PAIR).where(F.col("goal").isNull() | (F.col("least") <= F.col("goal")))
        # what a path costs above the straight one grows by half a round, so the rounds are few
        bound = bound.withColumn("upto", F.col("least") + F.greatest((F.col("least") - F.col("h")) / 2, F.col("least") * 1e-9) + F.col("h") / steps)
        open_ = waits.join(bound.select(*_PAIR, "upto", "goal"), _PAIR).where(F.col("goal").isNull() | (F.col("d") + F.col("ahead") <= F.col("goal")))
        active = stored(open_.where(F.col("d") + F.col("ahead") <= F.col("upto")).select(*_PAIR, "cell").distinct().join(bound, _PAIR).select(*_PAIR, "cell", "goal", "scale", "gx", "gy", "gz"))
        if active.isEmpty():
            break
        left = lambda p: (Vec.of(p) - Vec.of("g")).norm() * F.col("scale")
        edge = active.join(links, ["mesh_id", "cell"]).select(*_PAIR, "cell", F.lit(0).alias("kind"), "vid", none("d", "double"), none("prev", "long"), none("ahead", "double"), "nbr", "w", "ncell", left("n").alias("nahead"), "goal")
        tail = [none("nbr", "long"), none("w", "double"), none("ncell", "long"), none("nahead", "double"), none("goal", "double")]
        rows = edge.unionByName(waits.join(active.select(*_PAIR, "cell"), [*_PAIR, "cell"]).select(*_PAIR, "cell", F.lit(2).alias("kind"), "vid", "d", "prev", "ahead", *tail))
        if known is not None:
            rows = rows.unionByName(known.join(active.select(*_PAIR, "cell"), [*_PAIR, "cell"]).select(*_PAIR, "cell", F.lit(1).alias("kind"), "vid", "d", "prev", none("ahead", "double"), *tail))
        moved = stored(rows.select(*[x.split()[0] for x in _ROWS.split(", ")]).groupBy(*_PAIR, "cell").applyInArrow(_relax, _OUT))
        fresh = moved.where("kind = 1").select(*_PAIR, "cell", "vid", "d", "prev")
        known = fresh if known is None else known.unionByName(fresh)
        rest = open_.join(active.select(*_PAIR, "cell"), [*_PAIR, "cell"], "left_anti").select(*_PAIR, "cell", "vid", "d", "prev", "ahead")
        more = rest.unionByName(moved.where("kind = 2").select(*_PAIR, "cell", "vid", "d", "prev", "ahead"))
        best = F.min(F.struct("d", "prev", "ahead")).alias("b")
        last, waits = waits, stored(more.groupBy(*_PAIR, "cell", "vid").agg(best).select(*_PAIR, "cell", "vid", "b.d", "b.prev", "b.ahead"))
        discard(last, active)
    if known is None:
        empty = ends.limit(0).select(*_PAIR, F.col("src").alias("vid"), F.lit(0.0).alias("d"), none("prev", "long"))
        return empty.select(*_PAIR, "d"), empty
    least = F.min(F.struct(F.col("d"), F.coalesce("prev", F.lit(-1)).alias("p"), F.col("prev"))).alias("b")
    seen = stored(known.groupBy(*_PAIR, "vid").agg(least).select(*_PAIR, "vid", "b.d", "b.prev"))
    return seen.where(F.col("vid") == F.col("dst")).select(*_PAIR, "d"), seen
