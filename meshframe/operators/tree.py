"""A balanced tree of boxes as tables, and searches that go down it.

Items (points, or faces by their boxes) are split at quantiles of their widest axis, into
up to ``WAYS`` pieces a round, until no piece has more than ``LEAF`` items. A search starts
with all queries at the root; each round joins them with the children of their nodes and
keeps the children that can still matter, so a query meets a few leaves, never all items.

Rounds grow with the logarithm of the items, a leaf has a bounded size whatever the
clusters, and a node's rows can be split among tasks, as the other side has one row a node.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import Vec
from ..plans.iterate import Unfinished, discard, stored

#: Items of a leaf at most.
LEAF = 128
#: Pieces into which a node is split at most; 5 bits of a node's number.
WAYS, BITS = 32, 5
#: Levels that a 64-bit number can tell.
DEEPEST = 11

_BOX = [f"{e}{a}" for e in "lh" for a in "xyz"]


@dataclass(frozen=True)
class Tree:
    """items: leaf and the columns of what was built; kids: for each level, the children of
    its nodes as an array of structs (node, n, leaf, lx .. hz)."""

    items: DataFrame
    kids: list[DataFrame]


def build(items: DataFrame, low: Vec, high: Vec, leaf: int = LEAF, by_size: bool = False) -> Tree:
    """items: any columns but ``_node``; low and high: the corners of an item's box.

    With ``by_size`` the root is split by the boxes' sizes (powers of two), so that large
    ones do not widen the nodes of small ones. Items with equal centres are split by a hash."""
    names = items.columns
    own = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_item")
    at = [c.alias(f"_{n}") for v, e in ((low, "l"), (high, "h")) for c, n in zip(v, (f"{e}{a}" for a in "xyz"), strict=True)]
    now = items.select(own, *at, F.lit(1).cast("long").alias("_node"))
    now = stored(now.select("*", *[((F.col(f"_l{a}") + F.col(f"_h{a}")) / 2).alias(f"_c{a}") for a in "xyz"]))
    done, sums_of, spent = None, [], [now]
    for level in range(DEEPEST + 1):
        sums = [f(f"_{e}{a}").alias(f"{e}{a}") for e, f in (("l", F.min), ("h", F.max)) for a in "xyz"]
        spans = [f(f"_c{a}").alias(f"{n}{a}") for n, f in (("from", F.min), ("to", F.max)) for a in "xyz"]
        size = F.max(F.greatest(*[F.col(f"_h{a}") - F.col(f"_l{a}") for a in "xyz"])).alias("size")
        stats = stored(now.groupBy("_node").agg(F.count("*").alias("n"), *sums, *spans, size))
        big = F.lit(True) if by_size and level == 0 else F.col("n") > leaf
        sums_of.append(stats.select(F.lit(level).alias("level"), F.col("_node").alias("node"), "n", (~big).alias("leaf"), *_BOX))
        widest = F.greatest(*[F.struct((F.col(f"to{a}") - F.col(f"from{a}")).alias("w"), F.lit(k).alias("k"), F.col(f"from{a}").alias("from"), F.col(f"to{a}").alias("to")) for k, a in enumerate("xyz")])
        # as many pieces, a power of two, as make full leaves
        pieces = F.least(F.lit(float(WAYS)), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / leaf))))
        split = stats.where(big).select("_node", widest.alias("_w"), F.col("size").alias("_size"), (WAYS / F.greatest(pieces, F.lit(2.0))).cast("int").alias("_every"))
        split = split.select("_node", "_every", F.when(F.col("_w.w") > 0, F.col("_w.k")).otherwise(-1).alias("_axis"), F.col("_w.from").alias("_from"), F.col("_w.to").alias("_to"), "_size")
        rest = now.join(split.select("_node"), "_node", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        if split.isEmpty():
            break
        if level == DEEPEST:
            raise Unfinished(f"no leaves after {DEEPEST} levels")
        value = F.when(F.col("_axis") == 0, F.col("_cx")).when(F.col("_axis") == 1, F.col("_cy")).otherwise(F.col("_cz"))
        rows = now.join(split, "_node")
        if by_size and level == 0:
            span = F.greatest(*[F.col(f"_h{a}") - F.col(f"_l{a}") for a in "xyz"])
            piece = F.when(span > 0, F.least(F.lit(WAYS - 1), F.floor(F.log2(F.col("_size") / span)))).otherwise(WAYS - 1)
        else:
            marks = F.percentile_approx(value, [k / WAYS for k in range(1, WAYS)], 1000)
            cuts = rows.where("_axis >= 0").groupBy("_node", "_from", "_to", "_every").agg(marks.alias("q"))
            inner = F.array_distinct(F.filter("q", lambda b, k: (b < F.col("_to")) & ((k + 1) % F.col("_every") == 0)))
            half = F.col("_from") + (F.col("_to") - F.col("_from")) / 2
            inner = F.when(F.size(inner) > 0, inner).otherwise(F.array(F.when(half < F.col("_to"), half).otherwise(F.col("_from"))))
            rows = rows.join(cuts.select("_node", inner.alias("_cuts")), "_node", "left")
            piece = F.when(F.col("_axis") < 0, F.pmod(F.xxhash64("_item"), F.lit(WAYS))).otherwise(F.size(F.filter("_cuts", lambda b: b < value)))
        now = stored(rows.select("_item", *[f"_{c}" for c in _BOX], *[f"_c{a}" for a in "xyz"], (F.shiftleft("_node", BITS) + piece).cast("long").alias("_node")))
        spent.append(now)
    out = stored(done.select(F.col("_node").alias("leaf"), *[F.col(f"_item.`{c}`").alias(c) for c in names]))
    nodes = reduce(DataFrame.unionByName, sums_of)
    kid = F.struct("node", "n", "leaf", *_BOX)
    kids = stored(nodes.groupBy("level", F.shiftright("node", BITS).alias("above")).agg(F.collect_list(kid).alias("kids")))
    discard(*spent)
    return Tree(out, [kids.where(F.col("level") == k).select(F.col("above").alias("node"), "kids") for k in range(len(sums_of))])


def box_distance(p: Vec, box: Column) -> Column:
    """Squared distance of a point from a box (a struct lx .. hz)."""
    gap = Vec(*(F.greatest(box[f"l{a}"] - c, c - box[f"h{a}"], F.lit(0.0)) for a, c in zip("xyz", p, strict=True)))
    return gap.norm2()


def farthest(p: Vec, box: Column) -> Column:
    """Squared distance of a point from the farthest corner of a box."""
    gap = Vec(*(F.greatest(F.abs(box[f"l{a}"] - c), F.abs(c - box[f"h{a}"])) for a, c in zip("xyz", p, strict=True)))
    return gap.norm2()


def down(queries: DataFrame, tree: Tree, keep: Callable[[Column], Column]) -> DataFrame:
    """queries with the column leaf: a row for each leaf whose box, and all boxes above
    it, ``keep`` lets through."""
    names = queries.columns
    rows = queries.select("*", F.lit(0).cast("long").alias("_at"), F.lit(False).alias("_leaf"))
    for kids in tree.kids:
        ahead = rows.join(kids.select(F.col("node").alias("_at"), "kids"), "_at", "left")
        here = F.array(F.struct(F.col("_at").alias("node"), F.lit(True).alias("leaf")))
        on = F.transform(F.filter("kids", keep), lambda k: F.struct(k["node"].alias("node"), k["leaf"].alias("leaf")))
        rows = ahead.select(*names, F.explode(F.when(F.col("_leaf"), here).otherwise(on)).alias("_k")).select(*names, F.col("_k.node").alias("_at"), F.col("_k.leaf").alias("_leaf"))
    return rows.withColumnRenamed("_at", "leaf").drop("_leaf")


def first_leaf(queries: DataFrame, tree: Tree, n: int) -> DataFrame:
    """queries (x, y, z and more) with a near leaf, and ``within``: a squared distance in
    which there are n items (null where the tree has fewer)."""
    names, at = queries.columns, Vec.of()
    rows = queries.select("*", F.lit(0).cast("long").alias("_at"), F.lit(False).alias("_leaf"), F.lit(None).cast("double").alias("within"))
    for kids in tree.kids:
        ahead = rows.join(kids.select(F.col("node").alias("_at"), "kids"), "_at", "left")
        near = F.array_min(F.transform("kids", lambda k: F.struct(box_distance(at, k).alias("d2"), (-k["n"]).alias("n"), k["node"].alias("node"), k["leaf"].alias("leaf"))))
        bound = F.array_min(F.transform(F.filter("kids", lambda k: k["n"] >= n), lambda k: farthest(at, k)))
        rows = ahead.select(*names, "_at", "_leaf", F.least("within", bound).alias("within"), near.alias("_k"))
        rows = rows.select(*names, F.when(F.col("_leaf"), F.col("_at")).otherwise(F.col("_k.node")).alias("_at"), (F.col("_leaf") | F.col("_k.leaf")).alias("_leaf"), "within")
    return rows.withColumnRenamed("_at", "leaf").drop("_leaf")


def nearest_items(queries: DataFrame, tree: Tree, measured: Callable[[], Column], n: int = 1) -> DataFrame:
    """queries: qid, x, y, z. Each query with all items that may be among its n nearest: the
    items of one near leaf give a distance, then leaves within it are searched.
    ``measured``: a struct of d2, the squared distance of an item from the query, whose
    columns are qx, qy, qz, and of what else is wanted; its fields become columns."""
    q = stored(first_leaf(queries.select("qid", *Vec.of().columns()), tree, n))
    # a generator computes the struct once, else filters on it would repeat it
    met = lambda df: df.withColumnsRenamed({a: f"q{a}" for a in "xyz"}).join(tree.items, "leaf").select("*", F.inline(F.array(measured()))).drop("leaf")
    nth = F.min("d2") if n == 1 else F.try_element_at(F.sort_array(F.collect_list("d2")), F.lit(n))  # of a leaf's items
    seen = met(q.select("qid", "x", "y", "z", "leaf")).groupBy("qid").agg(nth.alias("seen"))
    within = F.coalesce(F.least("within", "seen"), F.lit(float("inf")))
    q = q.join(seen, "qid", "left").select("qid", "x", "y", "z", (within * (1 + 1e-12)).alias("within"))
    return met(down(q, tree, lambda k: box_distance(Vec.of(), k) <= F.col("within"))).where("d2 <= within").drop("within")
