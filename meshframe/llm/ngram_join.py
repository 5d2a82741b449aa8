"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

A document is the set of its distinct shingles. Two documents link when
100 * |A & B| >= least * |A | B|; the result is the connected components.

1. Bands. Sizes are cut into bands so wide that linked sets lie in the same band or
   in neighbouring ones.
2. Keys. For a pair of bands the symmetric difference of a linked pair has a known
   bound d. Shingles are dealt by hash into more than d parts, so a linked pair has
   parts that are equal in full. Their hashes are the keys on which documents meet;
   parts with few shingles are no keys, and there are so many more parts that an
   equal one remains. A document with too many thin parts is dealt again by another
   hash (its partners in a missed pair are, too), and at last meets on thin parts.
3. Signatures. What meets is compared by parity bitmaps first, which bound the overlap
   from above; only pairs within the bound go on to exact intersection.

``meeting`` does the rest: hubs, tiles, exact intersection and groups.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import meeting
from . import words as W
from .meeting import PAIR, TILE, bands, by_group, classes, keys_met, pairs_of, shingle_sets, tiles_of_keys
from .tables import discard, stored

#: Fewest bits of a signature.
BITS = 64
#: Hashes by which a document can be dealt before thin parts become keys.
SEEDS = 4
#: Fewest shingles of a part that is a key (in sets large enough for such parts).
THICK = 2


def dealing(low: int, high: int, far: int, least: int) -> tuple[int, int, int]:
    """For sizes low..high of a band and up to ``far`` in the next: parts, the fewest
    shingles of a key, and how many thin parts a document may have."""
    d = (100 - least) * (high + min(far, high * 100 // least)) // (100 + least)
    for thick in (THICK, 1) if low >= 12 * THICK else (1,):
        parts = d + 1
        while parts <= 4 * (d + 1):
            mean = low / parts
            thin = parts * sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(thick))
            need = d + 1 + (math.ceil(thin + 3 * math.sqrt(thin)) if thin > 1e-6 else 0)
            if parts >= need:
                return parts, thick, parts - d - 1
            parts = need
    return d + 1, 1, 0  # sets too small to leave room: documents with a thin part are dealt again


def keys_of(value: np.ndarray, begin: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys on which sets meet."""
    sizes = np.diff(begin)
    edges = bands(least, int(sizes.max(initial=1)))
    band = np.searchsorted(edges, sizes, side="right") - 1
    out_row, out_key = [], []
    for b in np.unique(band[sizes > 0]):
        rows = np.flatnonzero((band == b) & (sizes > 0))
        for level in (b, b - 1):  # pairs within band ``level`` and with the next one
            if level < 0:
                continue
            nxt = edges[level + 1] * 100 // least  # last size of the next band
            parts, thick, slack = dealing(edges[level], edges[level + 1] - 1, nxt, least)
            left = rows
            for seed in range(SEEDS):
                n = sizes[left]
                at = W.ranges(begin[left], n)
                v = W.mix(value[at] + np.uint64((1 + seed) * 0x9E3779B97F4A7C15 % 2**64))
                local = np.repeat(np.arange(len(left)), n)
                cell = local * parts + ((v >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
                held = np.bincount(cell, minlength=len(left) * parts)
                sums = np.zeros(len(left) * parts, dtype=np.uint64)
                order = np.argsort(cell, kind="stable")
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(v[order] ^ W._K2), dtype=np.uint64)])
                ends = np.cumsum(held)
                sums = total[ends] - total[ends - held]
                key = W.combine(sums + held.astype(np.uint64), (np.arange(len(sums)) % parts).astype(np.uint64) + np.uint64((int(level) * SEEDS + seed) << 32))
                full = np.flatnonzero(held >= thick)
                out_row.append(left[full // parts])
                out_key.append(key[full])
                thin = (held.reshape(len(left), parts) < thick).sum(axis=1)
                again = thin > slack
                if seed == SEEDS - 1 and again.any():
                    last = np.flatnonzero((held < thick) & again[np.arange(len(held)) // parts])
                    out_row.append(left[last // parts])
                    out_key.append(key[last])
                left = left[again]
                if not len(left):
                    break
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_row), np.concatenate(out_key)


def signatures(value: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps, one after the other, and where each begins in bytes: bit k says
    whether an odd number of shingles hash to k. Two sets differ in at least as many
    shingles as their bitmaps in bits. A bitmap has twice as many bits as its set has
    shingles, rounded up to a power of two, so its halves laid together are the bitmap of
    half the size."""
    n = np.diff(begin)
    bits = 1 << np.ceil(np.log2(np.maximum(2 * n, BITS))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(base[:-1], n) + (value & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8)), base // 8


def folded(mark: bytes, size: int) -> int:
    """The bitmap of ``size`` bytes as a number."""
    while len(mark) > size:
        half = len(mark) // 2
        mark = (int.from_bytes(mark[:half], "little") ^ int.from_bytes(mark[half:], "little")).to_bytes(half, "little")
    return int.from_bytes(mark, "little")


def within(n: int, a: bytes, m: int, b: bytes, least: int) -> bool:
    """Can sets of n and m shingles with these bitmaps be linked?"""
    size = min(len(a), len(b))
    most = min((n + m - (folded(a, size) ^ folded(b, size)).bit_count()) // 2, n, m)
    return 100 * most >= least * (n + m - most)


def near(ids: list[int], group: list[int], n: list[int], marks: list[bytes], least: int) -> list[tuple[int, int]]:
    """Pairs of one tile whose bitmaps are within the bound, as many as connect them;
    sets of one group are connected."""
    if len(ids) <= 16:
        label, out = list(group), []
        for q in range(1, len(ids)):
            for p in range(q):
                if label[p] != label[q] and ids[p] != ids[q] and within(n[p], marks[p], n[q], marks[q], least):
                    old, new = label[q], label[p]
                    label = [new if x == old else x for x in label]
                    out.append((ids[p], ids[q]))
        return out
    size = min(map(len, marks))
    rows = np.frombuffer(b"".join(folded(m, size).to_bytes(size, "little") for m in marks), dtype=np.uint64).reshape(len(marks), -1)
    label, sizes = np.unique(np.array(group), return_inverse=True)[1], np.array(n, dtype=np.int64)
    out, todo = [], np.ones(len(ids), dtype=bool)
    biggest = np.bincount(label)[label]
    for p in np.argsort(-biggest, kind="stable"):
        todo[p] = False
        far = np.flatnonzero(todo & (label != label[p]))
        if not len(far):
            continue
        both = sizes[far] + sizes[p]
        most = np.minimum((both - np.bitwise_count(rows[far] ^ rows[p]).sum(axis=1).astype(np.int64)) // 2, np.minimum(sizes[far], sizes[p]))
        for q in far[100 * most >= least * (both - most)].tolist():
            if label[q] != label[p]:
                label[label == label[q]] = label[p]
                if ids[p] != ids[q]:
                    out.append((ids[p], ids[q]))
    return out


def links(value: np.ndarray, begin: np.ndarray, least: int, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Linked pairs that connect the components of a tile (at most one less than sets);
    sets of one group are connected."""
    m = len(begin) - 1
    sizes = np.diff(begin).astype(np.int64)
    packed, base = signatures(value, begin)
    size = int(np.diff(base).min())
    raw = packed.tobytes()
    marks = np.frombuffer(b"".join(folded(raw[base[k] : base[k + 1]], size).to_bytes(size, "little") for k in range(m)), dtype=np.uint64).reshape(m, -1)
    ones = np.unpackbits(marks.view(np.uint8), axis=1)
    centre = np.packbits((2 * ones.sum(axis=0) > m).astype(np.uint8)).view(np.uint64)
    order = np.argsort(np.bitwise_count(marks ^ centre).sum(axis=1), kind="stable")  # hubs of a group of copies come first
    label, out = np.arange(m) if group is None else np.unique(group, return_inverse=True)[1], []
    todo = sizes > 0
    for p in order:
        if not todo[p]:
            continue
        todo[p] = False
        far = np.flatnonzero(todo & (label != label[p]))
        if not len(far):
            continue
        both = sizes[far] + sizes[p]
        most = np.minimum((both - np.bitwise_count(marks[far] ^ marks[p]).sum(axis=1).astype(np.int64)) // 2, np.minimum(sizes[far], sizes[p]))
        own = value[begin[p] : begin[p + 1]]
        for q in far[100 * most >= least * (both - most)].tolist():
            if label[q] == label[p]:
                continue
            other = value[begin[q] : begin[q + 1]]
            at = np.searchsorted(own, other)
            shared = int((own[np.minimum(at, len(own) - 1)] == other).sum())
            if 100 * shared >= least * (len(own) + len(other) - shared):
                label[label == label[q]] = label[p]
                out.append((int(p), q))
    return out


def _method(size: int, least: int, tile: int, lower: bool) -> meeting.Method:
    def sketch(value: np.ndarray, begin: np.ndarray) -> pa.Array:
        packed, base = signatures(value, begin)
        return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(base.astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])

    def may_link(n: list[int], marks: list[bytes], m: list[int], others: list[bytes]) -> list[bool]:
        return [within(*x, least) for x in zip(n, marks, m, others, strict=True)]

    return meeting.Method(size, least, lower, tile, sketch, functools.partial(keys_of, least=least), may_link, functools.partial(near, least=least), links)


def linked_pairs(documents: DataFrame, size: int = 4, least: int = 85, tile: int = TILE, lower: bool = True) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, not only those that connect them: pairs a < b of
    class representatives, and the membership doc_id, rep, n (documents of one class with
    n > 0 are linked, too). Rows count as in ``joined``.

    All pairs of a key are compared by their bitmaps, and all within the bound exactly, so
    a group of near copies costs the number of its links."""
    method = _method(size, least, tile, lower)
    docs, members, marks, parts = classes(documents, method)
    met = keys_met(docs, members, marks, method, parts)
    held = stored(met.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key", F.ceil(F.when(F.col("k") > tile, F.col("k") / max(1, tile // 2)).otherwise(1)).cast("int").alias("blocks")))
    at = tiles_of_keys(met, held).join(marks, "rep").select("t", "rep", "n", "mark")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, "t"):
            ids, n, own = (rows.column(c).to_pylist() for c in ("rep", "n", "mark"))
            for q in range(1, len(ids)):
                yield pairs_of([(min(ids[p], ids[q]), max(ids[p], ids[q])) for p in range(q) if ids[p] != ids[q] and within(n[p], own[p], n[q], own[q], least)])

    near_ = stored(at.repartition(parts, "t").sortWithinPartitions("t").mapInArrow(test, PAIR).distinct())
    many = stored(near_.groupBy("a").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks")))
    rows = near_.join(many, "a").withColumn("g", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("blocks"))))
    sent = rows.select("g", F.col("a").alias("doc_id"), F.lit(0).alias("part")).unionByName(rows.select("g", F.col("b").alias("doc_id"), F.lit(1).alias("part"))).distinct()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, "g"):
            ids, part_of, arrays = rows.column("doc_id").to_pylist(), rows.column("part").to_pylist(), []
            for _, _, part in W.chunks(rows.combine_chunks()):
                value, begin = shingle_sets(part, size, lower)
                arrays += np.split(value, begin[1:-1])
            out = []
            for k, x in enumerate(arrays):
                for q, y in enumerate(arrays) if part_of[k] == 0 and len(x) else ():
                    if part_of[q] == 1 and ids[k] < ids[q] and len(y):
                        shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                        if 100 * shared >= least * (len(x) + len(y) - shared):
                            out.append((ids[k], ids[q]))
            yield pairs_of(out)

    found = docs.join(sent, "doc_id").select("g", "doc_id", "part", "text").repartition(parts, "g").sortWithinPartitions("g").mapInArrow(exact, PAIR)
    found = stored(found.distinct())
    discard(met, held, near_, many, marks)
    return found, members.select("doc_id", "rep", "n").distinct()


def link_counts(documents: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_links: how many other documents each is linked to. For ids with several
    texts, the links of all of them."""
    pairs, members = linked_pairs(documents, **parameters)
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = members.where("n > 0").groupBy("rep").agg(F.countDistinct("doc_id").alias("size"))
    far = pairs.join(size.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("far"))
    per = size.join(far, "rep", "left").select("rep", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("k"))
    return members.join(per, "rep", "left").groupBy("doc_id").agg(F.sum(F.coalesce("k", F.lit(0))).alias("n_links"))


def joined(documents: DataFrame, size: int = 4, least: int = 85, tile: int = TILE, lower: bool = True) -> DataFrame:
    """A row per doc_id: doc_id, n_shingles, component_id; see ``meeting.joined``."""
    return meeting.joined(documents, _method(size, least, tile, lower))


def one_of_each(documents: DataFrame, **parameters) -> DataFrame:
    """The documents of the least id of each component, all columns kept; rows with a
    null id stay. For several rows of one id see ``meeting.least_of_each``."""
    return meeting.least_of_each(documents, joined(documents, **parameters))
