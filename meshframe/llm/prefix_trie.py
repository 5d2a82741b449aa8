"""Prefix trie of conversations by radix partitioning from the first turn on.

1. Dictionary. A turn is told by the SHA-256 of its role and text; each distinct turn
   gets a number, and a conversation becomes an array of numbers. No text is shuffled.
2. Radix. A bucket holds the conversations that share their first turns. A bucket of at
   most ``LOCAL`` turns (or of one conversation) is local. A larger one becomes nodes
   by aggregates: the turns that all its members share are those that its least and its
   greatest array share, so a run without a branch takes one round, however long; then
   it is dealt by the next turn's number into the buckets of the next round. Copies of
   one conversation end together and need no further round.
3. Multikey quicksort. A local bucket is split three ways around a turn's number, at the
   same turn for what is less or more and at the next for what is equal; each equal part
   is a node. Many buckets share a task.
4. Sums. Nodes of local buckets have theirs at once; those of the large ones are added up
   from the last round to the first, on tables of one row a large bucket.

A conversation is one row of two numbers a turn. Rounds grow with the branches along a
path of large buckets, not with its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .meeting import by_group
from .tables import discard, stored

#: Turns of a bucket that one task finishes at most.
LOCAL = 1 << 14
#: Turns of the conversation ``conv_id - conv_id % FAMILY`` that can stand in front.
FAMILY, FRONT = 5, 9

_KEY = ["parent", "at", "digit"]
_NONE = hashlib.sha256(b"").hexdigest()
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, seq: the turns of each conversation in order, as structs of turn, tie, id
    (one number a distinct role and text) and bytes (of the text). Ties in ``turn`` stand
    in the order of a hash of role and text. A stored table, dealt by family."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    sha = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), sha.alias("sha"), F.octet_length(text).alias("bytes"))
    rows = stored(rows)
    codes = stored(rows.groupBy("sha").agg(F.lit(1).alias("_")).select("sha", F.monotonically_increasing_id().alias("id")))
    turns = rows.join(codes, "sha").withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    turn = F.struct("turn", F.xxhash64("sha").alias("tie"), "id", "bytes")
    out = stored(turns.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list(turn)).alias("seq")))
    discard(rows, codes)
    return out


def rebuilt(seqs: DataFrame) -> DataFrame:
    """conv_id, ids, sizes: the first h turns of the family's first conversation, then the
    own turns after the h-th; h = crc32(conv_id as text) mod FRONT."""
    head = F.when(F.col("conv_id") == F.col("family"), F.slice("seq", 1, FRONT - 1))
    first = F.coalesce(F.max(head).over(Window.partitionBy("family")), F.slice("seq", 1, 0))  # a family has FAMILY rows at most
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % FRONT).cast("int")
    own = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))
    rows = seqs.withColumn("h", h).withColumn("first", first).select("conv_id", F.concat(F.slice("first", F.lit(1), F.col("h")), own).alias("seq"))
    return rows.select("conv_id", F.transform("seq", lambda x: x["id"]).alias("ids"), F.transform("seq", lambda x: x["bytes"]).alias("sizes"))


def plain(seqs: DataFrame) -> DataFrame:
    """conv_id, ids, sizes: each conversation as it is."""
    return seqs.select("conv_id", F.transform("seq", lambda x: x["id"]).alias("ids"), F.transform("seq", lambda x: x["bytes"]).alias("sizes"))


def _sha(ends: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest() if ends else _NONE


def local_nodes(convs: list[int], ids: list[list[int]], sizes: list[list[int]], at: int, parent: int) -> list[list]:
    """The nodes of a bucket whose members share their first ``at`` turns, the bucket's own
    node first: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    nodes: list[list] = []
    above: list[int] = []
    todo = [(list(range(len(convs))), at, -1)]
    while todo:
        who, d, up = todo.pop()
        ended, rest = [], []
        for k in who:
            (rest if len(ids[k]) > d else ended).append(k)
        me, children = len(nodes), 0
        parts = [rest]
        while parts:
            part = parts.pop()
            if part:
                pivot = ids[part[len(part) // 2]][d]
                less, same, more = [], [], []
                for k in part:
                    x = ids[k][d]
                    (same if x == pivot else less if x < pivot else more).append(k)
                todo.append((same, d + 1, me))
                children += 1
                parts += less, more
        over = nodes[up][0] if up >= 0 else parent if at else None
        saved = (len(who) - 1) * sizes[who[0]][d - 1] if d else 0
        nodes.append([min(convs[k] for k in who), d, over, len(who), children, 0 if children else 1, saved, _sha([convs[k] for k in ended])])
        above.append(up)
    for k in range(len(nodes) - 1, 0, -1):  # a node stands after its parent
        nodes[above[k]][5] += nodes[k][5]
        nodes[above[k]][6] += nodes[k][6]
    return nodes


def _frame(rows: list[list], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_COLUMNS = [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _NODES.split(", ")]


def _finished(light: DataFrame) -> DataFrame:
    """The nodes of all local buckets; ``top``: the bucket's own node."""
    columns = [*_COLUMNS, ("top", pa.bool_())]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        for rows in by_group(batches, *_KEY):
            found = local_nodes(*(rows.column(c).to_pylist() for c in ("conv_id", "ids", "sizes")), rows.column("at")[0].as_py(), rows.column("parent")[0].as_py())
            out += [[*node, k == 0] for k, node in enumerate(found)]
            if len(out) > 50_000:
                yield _frame(out, columns)
                out = []
        yield _frame(out, columns)

    return light.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(kernel, f"{_NODES}, top boolean")


def _digests(ends: DataFrame) -> DataFrame:
    """ends: node, depth, conv_id. The SHA-256 of each node's sorted ids. Ids are put in
    order by range, whatever node they belong to; then a node's joined pieces, a row for
    some thousands of ids, pass through one hash in order."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, depth, conv = (batch.column(c).to_numpy() for c in ("node", "depth", "conv_id"))
            cuts = [0, *(np.flatnonzero((node[1:] != node[:-1]) | (depth[1:] != depth[:-1])) + 1).tolist(), len(node)]
            rows = [[int(node[a]), int(depth[a]), int(conv[a]), ",".join(map(str, conv[a:b].tolist()))] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
            yield _frame(rows, [("node", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, columns = None, hashlib.sha256(), [("node", pa.int64()), ("depth", pa.int64()), ("ends", pa.string())]
        for batch in batches:
            out = []
            for node, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "piece")), strict=True):
                if last == (node, depth):
                    state.update(b"," + piece.encode())
                    continue
                if last is not None:
                    out.append([*last, state.hexdigest()])
                last, state = (node, depth), hashlib.sha256(piece.encode())
            yield _frame(out, columns)
        if last is not None:
            yield _frame([[*last, state.hexdigest()]], columns)

    pieces = ends.repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id").mapInArrow(joined, "node long, depth long, first long, piece string")
    return pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(hashed, "node long, depth long, ends string")


def _spelled(chains: DataFrame) -> DataFrame:
    """Rows of runs without a branch as nodes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = [(r["n"] - 1) * s for s in r["sizes"]]
                if r["at"] == 0:
                    own = [0, *own]
                saved = (np.cumsum(np.array(own[::-1], dtype=np.int64))[::-1] + r["saved"]).tolist()
                rows = []
                for k, s in enumerate(saved):
                    d, last = r["at"] + k, k == len(saved) - 1
                    over = r["node"] if k else r["parent"] if d else None
                    rows.append([r["node"], d, over, r["n"], r["children"] if last else 1, r["leaves"], s, (r["ends"] or _NONE) if last else _NONE])
                yield _frame(rows, _COLUMNS)

    return chains.mapInArrow(kernel, _NODES)


def trie(sequences: DataFrame, local: int = LOCAL) -> DataFrame:
    """sequences: conv_id (unique, not null), ids, sizes (arrays of one length, maybe
    empty). A row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (over its subtree, (n_convs - 1) times the size of
    the node's last turn), ends_sha256 (of the members that end there). No sequences, no
    nodes."""
    state = stored(sequences.select(F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("at"), F.lit(-1).cast("long").alias("digit"), "conv_id", "ids", "sizes"))
    light, rounds, ends, spent = [], [], [], []
    while True:
        turns = F.sum(F.size("ids") - F.col("at") + 1)
        big = stored(state.groupBy(*_KEY).agg(F.count("*").alias("n"), turns.alias("turns")).where((F.col("n") > 1) & (F.col("turns") > local)).select(*_KEY, "n"))
        if big.isEmpty():
            light.append(state)
            break
        light.append(state.join(big, _KEY, "left_anti"))
        members = state.join(big, _KEY)
        runs = members.groupBy(*_KEY, "n").agg(F.min("conv_id").alias("node"), F.min(F.struct("ids", "sizes")).alias("lo"), F.max("ids").alias("hi"))
        differ = F.array_position(F.zip_with("lo.ids", "hi", lambda x, y: x.eqNullSafe(y)), False)
        shared = F.when(differ > 0, differ - 1).otherwise(F.size("lo.ids")).cast("long")
        begin = F.greatest(F.col("at"), F.lit(1)).cast("int")
        run = stored(runs.withColumn("end", shared).select(*_KEY, "n", "node", "end", F.slice("lo.sizes", begin, F.greatest(F.col("end").cast("int") - begin + 1, F.lit(0))).alias("sizes")))
        rounds.append(run)
        placed = state.join(run.select(*_KEY, "node", "end"), _KEY)
        ends.append(placed.where(F.size("ids") == F.col("end")).select("node", F.col("end").alias("depth"), "conv_id"))
        ahead = placed.where(F.size("ids") > F.col("end"))
        state = stored(ahead.select(F.col("node").alias("parent"), (F.col("end") + 1).alias("at"), F.element_at("ids", (F.col("end") + 1).cast("int")).alias("digit"), "conv_id", "ids", "sizes"))
        spent.append(big)
    rows = light[0]
    for more in light[1:]:
        rows = rows.unionByName(more)
    found = stored(_finished(rows.select(*_KEY, "conv_id", "ids", "sizes")))
    discard(*spent)
    out = found.drop("top")
    if not rounds:
        return out
    tops = found.where("top").select("parent_conv_id", "depth", "n_leaves", "saved_tokens")
    below = stored(tops.groupBy(F.col("parent_conv_id").alias("node"), (F.col("depth") - 1).alias("end")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")))
    summed: list[DataFrame] = []
    for run in reversed(rounds):
        kids = below
        if summed:
            size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
            kids = kids.unionByName(summed[-1].select(F.col("parent").alias("node"), (F.col("at") - 1).alias("end"), F.lit(1).cast("long").alias("c"), F.col("leaves").alias("l"), (F.col("saved") + (F.col("n") - 1) * size).alias("s")))
        kids = kids.groupBy("node", "end").agg(F.sum("c").alias("c"), F.sum("l").alias("l"), F.sum("s").alias("s"))
        zero = lambda c, k: F.coalesce(c, F.lit(k).cast("long"))
        summed.append(stored(run.join(kids, ["node", "end"], "left").select(*run.columns, zero("c", 0).alias("children"), zero("l", 1).alias("leaves"), zero("s", 0).alias("saved"))))
    all_runs, all_ends = summed[0], ends[0]
    for more in summed[1:]:
        all_runs = all_runs.unionByName(more)
    for more in ends[1:]:
        all_ends = all_ends.unionByName(more)
    runs = all_runs.join(_digests(all_ends).withColumnRenamed("depth", "end"), ["node", "end"], "left")
    return out.unionByName(_spelled(runs.select("node", "at", "parent", "n", "children", "leaves", "saved", "sizes", "ends")))


def nodes(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of rebuilt conversations, see ``rebuilt`` and ``trie``.

    conversations: conv_id, turn, role, text. Null role or text is empty; a null turn
    comes first; every row is a turn, repeated rows too; rows with a null conv_id belong
    to no conversation and are dropped; other columns are not read. An empty table has no
    nodes."""
    seqs = encoded(conversations)
    return trie(rebuilt(seqs), local)
