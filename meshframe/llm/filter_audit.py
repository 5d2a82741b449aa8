"""Filter interaction audit: what filters take away from each other, in every order.

1. Checks. One pass over the texts gives each row its failures A to D as bits, its length
   in code points and the hashes of its successive blocks (each ``GROW`` times as long as
   all before it), so a text has few of them.
2. Duplicates by refinement, on these numbers alone: rows are split by length, then by the
   hash of one block after another, and rows that stand alone are dropped at once. Classes
   that survive all blocks are compared as full texts; in each group of equal texts the
   rows above the least id fail E.
3. Counts. Rows become counts by part, failures and labels before anything is ordered.
   The 120 orders are sums of these 32 kinds of failures, a matrix for each number.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .katz import _bitmap
from .tables import discard, stored

FILTERS = "ABCDE"
#: log2 of the bits of the map of rows whose texts are compared (2 MB).
MAP_BITS = 24
#: First block in bytes, and how many times as long as all before it each next one is.
BLOCK, GROW = 64, 7

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARKUP = np.zeros(256, dtype=bool)
_MARKUP[[ord(c) for c in "#$%&*|"]] = True


def blocks(text: bytes) -> list[int]:
    """Hashes of the successive blocks of a text; an empty text has none."""
    out, low, high = [], 0, BLOCK
    while low < len(text):
        out.append(int.from_bytes(hashlib.blake2b(text[low:high], digest_size=8).digest(), "little", signed=True))
        low, high = high, high * (GROW + 1)
    return out


def failures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Failures A to D of each text as bits 1, 2, 4 and 8, and its code points."""
    chunk = W.Chunk(texts)
    n = np.diff(chunk.first)
    h = chunk.hashes()
    order = np.lexsort((h, chunk.doc))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (chunk.doc[order][1:] != chunk.doc[order][:-1])
    distinct = np.bincount(chunk.doc[order][new], minlength=chunk.rows)
    data = chunk.bytes[: chunk.size]

    def count(marks: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return upto[chunk.offsets[1:]] - upto[chunk.offsets[:-1]]

    points = count((data & 0xC0) != 0x80)
    bits = (n < 50) * 1 + (100 * distinct < 65 * n) * 2 + (100 * count(_UPPER[data]) > 5 * points) * 4 + (count(_MARKUP[data]) > 0) * 8
    return bits.astype(np.int32), points


def checked(documents: DataFrame) -> DataFrame:
    """doc_id, part, bits, n (code points), blocks: a row for each row of documents."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, part in W.chunks(batch):
                bits, points = failures(part)
                hashes = pa.array([blocks(t.encode()) for t in part.to_pylist()], pa.list_(pa.int64()))
                own = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("part"), pa.array(bits), pa.array(points, pa.int64()), hashes], names=["doc_id", "part", "bits", "n", "blocks"])
        W.trim()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, part string, bits int, n long, blocks array<long>")


def refined(rows: DataFrame) -> DataFrame:
    """rows: doc_id, n, blocks. doc_id and cls (a hash of length and blocks) of the rows
    that share both with a row of another id. A stored table."""
    now = rows.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("n").alias("cls"), "blocks")

    def shared(df: DataFrame) -> DataFrame:
        many = df.groupBy("cls").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).where("_lo <> _hi").select("cls")
        return df.join(many, "cls").select("doc_id", "cls", "blocks")

    now, k = stored(shared(now)), 0
    while not now.where(F.size("blocks") > k).isEmpty():
        cls = F.when(F.size("blocks") > k, F.xxhash64("cls", F.try_element_at("blocks", F.lit(k + 1)))).otherwise(F.col("cls"))
        last, now, k = now, stored(shared(now.select("doc_id", cls.alias("cls"), "blocks"))), k + 1
        discard(last)
    return now


def class_of(n: str, hashes: str) -> Column:
    """The class in which ``refined`` leaves a row."""
    return F.aggregate(hashes, F.xxhash64(n), lambda a, x: F.xxhash64(a, x))


def duplicates(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: as ``checked`` gives them. doc_id and cls, once each, of the rows whose text
    is that of a row of a smaller id. Texts of classes that survive ``refined`` are
    compared in full, by grouping; copies are one row before their shuffle."""
    found = refined(rows).select("doc_id", "cls")

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array([len(t) for t in texts], pa.int64()), pa.array([blocks(t.encode()) for t in texts], pa.list_(pa.int64()))], names=["doc_id", "text", "n", "blocks"])

    texts = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a map of fixed size spares other texts the way; those that it lets through are alone
    # in their class and text, so they change nothing
    place = F.xxhash64("doc_id")
    known = documents.sparkSession.sparkContext.broadcast(_bitmap(found.select(place.alias("key")), MAP_BITS))

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - MAP_BITS)
            keep = (known.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            yield from blocked(iter([batch.filter(pa.array(keep.astype(bool)))]))

    texts = texts.withColumn("place", place).mapInArrow(survivors, "doc_id long, text string, n long, blocks array<long>")
    texts = texts.select("doc_id", "text", class_of("n", "blocks").alias("cls"))
    groups = stored(texts.groupBy("cls", "text").agg(F.min("doc_id").alias("first")).select("cls", F.sha2("text", 256).alias("sha"), "first"))
    single = stored(groups.groupBy("cls").agg(F.count("*").alias("k"), F.min("first").alias("first")))
    out = found.join(single.where("k = 1"), "cls").where("doc_id > first").select("doc_id", "cls")
    if not single.where("k > 1").isEmpty():  # different texts of equal length and hashes
        rest = texts.join(single.where("k > 1").select("cls"), "cls").select("doc_id", "cls", F.sha2("text", 256).alias("sha"))
        out = out.unionByName(rest.join(groups, ["cls", "sha"]).where("doc_id > first").select("doc_id", "cls"))
    return out.distinct()


def orders() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """All orders and steps; and for each, the kinds of failures (sets of filters as bits)
    that each number counts."""
    kinds = np.arange(1 << len(FILTERS))
    steps, rows = [], {"kept": [], "removed": [], "redundant": [], "unique_fails": []}
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(FILTERS[x] for x in order), k + 1))
            fails, gone = (kinds >> f) & 1 == 1, (kinds & before) != 0
            before |= 1 << f
            rows["kept"].append((kinds & before) == 0)
            rows["removed"].append(fails & ~gone)
            rows["redundant"].append(fails & gone)
            rows["unique_fails"].append(kinds == 1 << f)
    return steps, {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


_NUMBERS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents: doc_id, text, source; labels: doc_id, quality, toxic. A row per part,
    filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley.

    Each row of documents counts as a document, repeated rows too. A null text is empty, a
    null source an empty one. A row with a null id is neither a duplicate nor makes one,
    and has no label. Of several labels of an id, any with quality or toxic 1 counts.
    Other columns are not read. An empty table has no parts."""
    rows = stored(checked(documents))
    copies = duplicates(documents, rows).withColumn("e", F.lit(1 << 4))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    seen = rows.select("doc_id", "part", "bits", class_of("n", "blocks").alias("cls")).join(known, "doc_id", "left").join(copies, ["doc_id", "cls"], "left")
    kind = F.col("bits") + F.coalesce("e", F.lit(0))
    counts = seen.groupBy("part", kind.alias("kind"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count("*").alias("n"))
    per = lambda what: F.array(*[F.sum(F.when(F.col("kind") == k, F.col("n") * what).otherwise(0)) for k in range(1 << len(FILTERS))])
    parts = counts.groupBy("part").agg(per(F.lit(1)).alias("n"), per(F.col("good")).alias("good"), per(F.col("toxic")).alias("toxic"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, kinds = orders()
        names, numbers = pa.array([o for o, _ in steps]), pa.array([k for _, k in steps], pa.int32())
        letter = np.array([FILTERS.index(o[k - 1]) for o, k in steps])
        for batch in batches:
            for r in batch.to_pylist():
                out = {k: m @ np.array(r["n"], dtype=np.int64) for k, m in kinds.items()}
                out |= {f"{k}_lost": kinds["removed"] @ np.array(r[k], dtype=np.int64) for k in ("good", "toxic")}
                total = np.zeros(len(FILTERS), dtype=np.int64)
                np.add.at(total, letter, out["removed"])
                out["shapley"] = total[letter]
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(steps)), names, numbers, *[pa.array(out[k]) for k in _NUMBERS]], names=["part", "filter_order", "step", *_NUMBERS])

    return parts.mapInArrow(kernel, "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in _NUMBERS))
