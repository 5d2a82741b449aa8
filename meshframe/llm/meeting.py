"""Documents whose shingle sets are alike: how they meet, are compared and grouped.

A method says how a set is sketched, on which keys sets meet, and which pairs of sketches
may be linked; what is here does the rest the same way for every method.

* Exact copies of a set are one class first, and one of them stands for all.
* Each set meets one hub, the least set of the keys that it shares most of; then every key
  whose sets are not yet one group is a tile (or, if large, tiles of two blocks), where
  sets of different groups are compared by their sketches. So copies and near copies of
  one text cost their number, not its square, and no text moves for refused pairs.
* The groups that remaining pairs connect are counted by exact intersection of sorted
  arrays, in tiles of bounded size. A larger group is cut into blocks that each hold its
  hub; only if that leaves it in pieces do blocks meet, banded by size. Pairs that are
  already connected are not compared again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .tables import discard, quoted, stored, tasks

#: Documents of a tile, at most about.
TILE = 2048

PAIR = "a long, b long"


@dataclass(frozen=True)
class Method:
    """``size`` and ``lower`` make the shingles, ``least`` is the similarity in hundredths.
    ``sketch`` takes the sorted sets of a chunk (values, begins), ``keys`` as well, or
    with ``keys_of_marks`` sketches; ``may_link`` takes sizes and sketches of two sets, ``near`` those of a tile and the
    group of each set, and gives pairs that connect the groups."""

    size: int
    least: int
    lower: bool
    tile: int
    sketch: Callable[[np.ndarray, np.ndarray], pa.Array]
    keys: Callable[..., tuple[np.ndarray, np.ndarray]]
    may_link: Callable[[list[int], list[bytes], list[int], list[bytes]], list[bool]]
    near: Callable[[list[int], list[int], list[int], list[bytes]], list[tuple[int, int]]]
    links: Callable[[np.ndarray, np.ndarray, int, np.ndarray], list[tuple[int, int]]]
    keys_of_marks: bool = False


def shingle_sets(texts: pa.Array, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each
    text's begin (one more than texts). A text of fewer words is one shingle."""
    chunk = W.Chunk(texts, lower=lower)
    h = chunk.hashes()
    count = np.diff(chunk.first)
    start, row = W.windows(chunk.first, size)
    values = [W.gram_hashes(h, size)[start]]
    rows = [row]
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        if len(short):
            values.append(W.gram_hashes(h, k)[chunk.first[short]])
            rows.append(short)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.argsort(value)
    small = row[order].astype(np.uint16 if len(texts) < 65536 else np.int64)
    order = order[np.argsort(small, kind="stable")]
    value, row = value[order], row[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(texts) + 1))


def fingerprints(value: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    ends = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    one, two = ends(W.mix(value)), ends(W.mix(value ^ np.uint64(0x5851F42D4C957F2D)))
    return one[begin[1:]] - one[begin[:-1]], two[begin[1:]] - two[begin[:-1]]


def bands(least: int, up_to: int) -> list[int]:
    """First size of each band: linked sizes are in one band or in neighbours."""
    out = [1]
    while out[-1] <= up_to:
        out.append(out[-1] * 100 // least + 1)
    return out


def by_group(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.Table]:
    """Tables of the rows of one key each; rows of a key follow one another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch) - 1, dtype=bool)
        for c in columns:
            key = batch.column(c).to_numpy(zero_copy_only=False)
            new |= key[1:] != key[:-1]
        if held and any(held[-1].column(c)[len(held[-1]) - 1] != batch.column(c)[0] for c in columns):
            yield pa.Table.from_batches(held)
            held = []
        low = 0
        for high in (np.flatnonzero(new) + 1).tolist():
            yield pa.Table.from_batches([*held, batch.slice(low, high - low)])
            held, low = [], high
        held.append(batch.slice(low))
    if held:
        yield pa.Table.from_batches(held)


def pairs_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([q for _, q in found], pa.int64())], names=["a", "b"])


def _sets(docs: DataFrame, method: Method) -> DataFrame:
    """doc_id, n, one, two, mark: the size of each text's set, two hashes of it, its sketch."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, part in W.chunks(batch):
                value, begin = shingle_sets(part, method.size, method.lower)
                one, two = fingerprints(value, begin)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(begin)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), method.sketch(value, begin)], names=["doc_id", "n", "one", "two", "mark"])
        W.trim()

    return docs.mapInArrow(prints, "doc_id long, n long, one long, two long, mark binary")


def classes(documents: DataFrame, method: Method) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The documents with an id and a text column; their classes of equal sets (doc_id, n,
    rep: the least id of the class, the own id for empty sets); a sketch per class; and how
    many tasks the shuffles after it need."""
    docs = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stored(_sets(docs, method))
    # equal sets have equal sketches
    marks = stored(sets.where("n > 0").groupBy("n", "one", "two").agg(F.min("doc_id").alias("rep"), F.first("mark").alias("mark")))
    members = stored(sets.drop("mark").join(marks.drop("mark"), ["n", "one", "two"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")))
    discard(sets)
    return docs, members, marks, tasks(docs.sparkSession, members.count())


def keys_met(docs: DataFrame, members: DataFrame, marks: DataFrame, method: Method, parts: int) -> DataFrame:
    """key, rep: the keys on which at least two classes meet. A stored table."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, part in W.chunks(batch):
                value, begin = shingle_sets(part, method.size, method.lower)
                one, two = fingerprints(value, begin)
                order = np.lexsort((two, one))  # of equal sets of a chunk one brings keys
                first = np.ones(len(order), dtype=bool)
                first[order[1:]] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
                keep = np.repeat(first, np.diff(begin))
                sizes = np.where(first, np.diff(begin), 0)
                row, key = method.keys(value[keep], np.concatenate([[0], np.cumsum(sizes)]))
                ids = batch.column(0).slice(low, high - low).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row])], names=["key", "doc_id"])
        W.trim()

    def emit_of_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key = method.keys(batch.column("mark").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("rep").take(pa.array(row))], names=["key", "doc_id"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row so far, and whether it is told
        for batch in batches:
            key, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            told = False
            if last is not None:
                key, doc, told = np.append(last[0], key), np.append(last[1], doc), last[2]
            if not len(key):
                continue
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            key, doc = key[fresh], doc[fresh]
            same = key[1:] == key[:-1]
            out = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            last = (key[-1:], doc[-1:], bool(out[-1]) or (told and len(key) == 1))
            out[0] &= not told
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(doc[out])], names=["key", "doc_id"])

    told = marks.select("rep", "mark").mapInArrow(emit_of_marks, "key long, doc_id long") if method.keys_of_marks else docs.mapInArrow(emit, "key long, doc_id long")
    shared = told.repartition(parts, "key").sortWithinPartitions("key", "doc_id").mapInArrow(meet, "key long, doc_id long")
    if method.keys_of_marks:
        return stored(shared.withColumnRenamed("doc_id", "rep"))
    keys = stored(shared)
    met = stored(keys.join(members.where("n > 0").select("doc_id", "rep").distinct(), "doc_id").select("key", "rep").distinct())
    discard(keys)
    return met


def _hubs(met: DataFrame, marks: DataFrame, method: Method) -> DataFrame:
    """met: key, rep. A pair (a, b) that may link for each set a and its hub b: of the
    least sets of its keys, the one that it meets most often. Both sides of every join
    are stored, so a hub's rows can be split."""
    first = stored(met.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("_top")).where("hub <> _top").select("key", "hub"))
    often = met.join(first, "key").where("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("n"))
    best = stored(often.groupBy("rep").agg(F.max_by("hub", F.struct(F.col("n"), (-F.col("hub")).alias("h"))).alias("hub")))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, mark, m, other = (c.to_pylist() for c in batch.columns)
            yield pairs_of([p for *p, ok in zip(a, b, method.may_link(n, mark, m, other), strict=True) if ok])

    both = best.join(marks, "rep").join(marks.select(F.col("rep").alias("hub"), F.col("n").alias("m"), F.col("mark").alias("other")), "hub")
    out = stored(both.select("rep", "hub", "n", "mark", "m", "other").mapInArrow(test, PAIR).distinct())
    discard(first, best)
    return out


def tiles_of_keys(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows: key, rep and more; held: key, blocks. A row for each tile t that a row belongs
    to: a key's own, or those of all pairs of its block with another."""
    i = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("i", j), F.greatest("i", j))))
    return rows.join(held, "key").withColumn("i", i).withColumn("t", F.explode(tiles)).drop("i", "blocks", "key")


def _others(met: DataFrame, hubs: DataFrame, marks: DataFrame, method: Method, parts: int) -> DataFrame:
    """Further pairs that may link, from the keys whose sets are not all of one hub."""
    above = hubs.select(F.col("a").alias("b"), F.col("b").alias("top"))
    group = stored(hubs.join(above, "b", "left").groupBy("a").agg(F.min(F.coalesce("top", "b")).alias("grp")).withColumnRenamed("a", "rep"))
    rows = stored(met.join(group, "rep", "left").select("key", "rep", F.coalesce("grp", "rep").alias("grp")))
    tile = method.tile
    open_ = stored(rows.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("k")).where("lo <> hi").select("key", F.ceil(F.when(F.col("k") > tile, F.col("k") / (tile // 2)).otherwise(1)).cast("int").alias("blocks")))
    at = tiles_of_keys(rows, open_).join(marks, "rep").select("t", "rep", "grp", "n", "mark")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for rows in by_group(batches, "t"):
            if len(rows) > 1:
                out += method.near(*(rows.column(c).to_pylist() for c in ("rep", "grp", "n", "mark")))
            if len(out) > 50_000:
                yield pairs_of(out)
                out = []
        yield pairs_of(out)

    out = stored(at.repartition(parts, "t").sortWithinPartitions("t").mapInArrow(test, PAIR).distinct())
    discard(group, rows, open_)
    return out


def _compared(docs: DataFrame, tiles: DataFrame, method: Method, parts: int) -> DataFrame:
    """tiles: g, doc_id, grp (sets of one group are connected). Linked pairs, by exact
    intersection, as many as connect each tile; a stored table."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, "g"):
            ids, group, arrays = rows.column("doc_id").to_numpy(), rows.column("grp").to_numpy(), []
            for _, _, part in W.chunks(rows.combine_chunks()):
                value, begin = shingle_sets(part, method.size, method.lower)
                arrays += np.split(value, begin[1:-1])
            if len(ids) > 1:
                begin = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int64)
                yield pairs_of([(int(ids[p]), int(ids[q])) for p, q in method.links(np.concatenate(arrays), begin, method.least, group) if ids[p] != ids[q]])

    texts = docs.join(tiles, "doc_id").select("g", "doc_id", "grp", "text")
    return stored(texts.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(compare, PAIR))


def _banded(rows: DataFrame, least: int, tile: int) -> DataFrame:
    """rows: node, root, n, grp. Tiles of groups that are too large for one: nodes fall
    into blocks by size band and hash, and a tile is a pair of blocks of one band or of
    neighbouring ones. Returns g, doc_id, grp."""
    band = F.lit(0)
    for first in bands(least, 1 << 40)[1:]:
        band = band + (F.col("n") >= F.lit(first)).cast("int")
    rows = stored(rows.withColumn("band", band))
    held = rows.groupBy("root", "band").agg(F.ceil(F.count("*") / max(1, tile // 2)).cast("int").alias("blocks"))
    blocks = stored(held.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks")))  # a few hundred bands
    nb = lambda b: F.coalesce(F.try_element_at("blocks", b), F.lit(0))
    upto = lambda b: F.when(nb(b) > 0, F.sequence(F.lit(0), nb(b) - 1)).otherwise(F.array().cast("array<int>"))
    b = F.col("band")
    rows = rows.join(blocks, "root").withColumn("i", F.pmod(F.xxhash64("node"), nb(b)).cast("int"))
    inside = F.transform(upto(b), lambda j: F.xxhash64("root", b, b, F.least("i", j), F.greatest("i", j)))
    ahead = F.transform(upto(b + 1), lambda j: F.xxhash64("root", b, b + 1, F.col("i"), j))
    behind = F.transform(upto(b - 1), lambda j: F.xxhash64("root", b - 1, b, j, F.col("i")))
    return rows.select(F.explode(F.array_distinct(F.concat(inside, ahead, behind))).alias("g"), F.col("node").alias("doc_id"), "grp")


def joined(documents: DataFrame, method: Method) -> DataFrame:
    """documents: doc_id, text. A row per doc_id: doc_id, n_shingles, component_id (the
    least doc_id reachable by links, itself included).

    Null, empty and wordless texts are empty sets and link with nothing. Repeated rows
    are one document; rows of one id with other texts give it the larger set and all
    their links. Rows with a null id and all other columns are dropped."""
    tile = method.tile
    docs, members, marks, parts = classes(documents, method)
    own = stored(members.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("top"), F.max("n").alias("n")))

    met = keys_met(docs, members, marks, method, parts)
    hubs = _hubs(met, marks, method)
    more = _others(met, hubs, marks, method, parts)
    groups = stored(components(hubs.unionByName(more)))
    discard(met, more)

    total = groups.groupBy("root").agg(F.count("*").alias("total")).where(F.col("total") > tile)
    total = stored(total.select("root", F.ceil(F.col("total") / tile).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiles = groups.join(total, "root", "left").select(F.when(F.col("blocks").isNull(), F.xxhash64("root")).otherwise(F.xxhash64("root", block)).alias("g"), F.col("node").alias("doc_id"))
    # the hub that most sets of a large group have stands in all its blocks
    degree = hubs.groupBy("b").agg(F.count("*").alias("n")).join(groups.withColumnRenamed("node", "b"), "b").groupBy("root").agg(F.max_by("b", F.struct("n", "b")).alias("hub"))
    spread = degree.join(total, "root").select(F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("root", j))).alias("g"), F.col("hub").alias("doc_id"))
    tiles = tiles.unionByName(spread).distinct().withColumn("grp", F.col("doc_id"))
    found = _compared(docs, tiles, method, parts)
    split = members.join(own.where("rep <> top").select("doc_id", F.col("rep").alias("lo")), "doc_id").select(F.col("lo").alias("a"), F.col("rep").alias("b"))
    edges = stored(found.unionByName(split))
    roots = stored(components(edges))
    if not total.isEmpty():  # large groups that their hub left in pieces
        large = groups.join(total, "root").join(roots.withColumnRenamed("root", "grp"), "node", "left").select("node", "root", F.coalesce("grp", "node").alias("grp"))
        large = stored(large)
        pieces = stored(large.groupBy("root").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("root"))
        rest = large.join(pieces, "root").join(marks.groupBy(F.col("rep").alias("node")).agg(F.max("n").alias("n")), "node")
        more_found = _compared(docs, _banded(rest, method.least, tile), method, parts)
        roots = stored(components(edges.unionByName(more_found)))
        discard(large, pieces, more_found)
    discard(found, hubs, groups, total, marks, edges, members)
    out = own.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.least("doc_id", F.coalesce("root", "rep")).alias("component_id"))


def least_of_each(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents whose id is the least of its group, all columns kept; rows with a null
    id stay. groups: doc_id, component_id. Of several rows of one id the one with the least
    text stays (null last), of those the one that is least as JSON."""
    names = documents.columns
    rows = documents.select("doc_id", F.col("text").cast("string").alias("_text"), F.struct(*[F.col(quoted(c)) for c in names]).alias("_row"))
    repeated = stored(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"))
    gone = groups.where("component_id <> doc_id").select("doc_id")
    once = rows.join(gone.unionByName(repeated), "doc_id", "left_anti").select("_row")
    if not repeated.isEmpty():
        order = F.struct(F.col("_text").isNull(), "_text", F.to_json("_row"))
        chosen = rows.join(repeated, "doc_id").join(gone, "doc_id", "left_anti").groupBy("doc_id").agg(F.min_by("_row", order).alias("_row"))
        once = once.unionByName(chosen.select("_row"))
    return once.select(*[F.col(f"_row.{quoted(c)}").alias(c) for c in names])
