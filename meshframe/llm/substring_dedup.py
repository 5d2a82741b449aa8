"""Substring dedup: suffix trees over groups of suffixes with a common prefix.

A repeat is a run of ``length`` words that starts in two documents. Every such run
holds an anchor, the ``PREFIX`` words in it with the least hash, and equal runs have
the same anchor. So suffixes need to meet only on anchors that stand in two
documents:

1. Anchors are counted by hash over all documents, with the suffixes that they lead.
   Those of one document alone are dropped by a bitmap of bounded size, which may let
   some through but loses none.
2. Suffixes are dealt to groups by prefix: the words of their anchor, or, where that
   group has too many suffixes, the whole run (the longest prefix). Before they are
   sent, each chunk settles what repeats within it and keeps one document of each
   run, so a passage of a third of all documents is one suffix a chunk.
3. Each group becomes a suffix tree, cut off at ``length`` words: its suffixes in order,
   with the number of words that neighbours share. Its nodes of that depth are the
   repeats; all documents below a node but the least give up these words. Deeper nodes
   would change nothing, as overlapping runs of a longer repeat are found one by one.

Words are compared by 64-bit hashes within a chunk and by 32 bits of these between
chunks, where the 64-bit hash of the prefix must be equal, too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import quoted, stored

#: Words of an anchor.
PREFIX = 4
#: log2 of the bits of the bitmap of repeated anchors (16 MB).
FILTER_BITS = 27
#: Anchors with more suffixes than this, or a hundred-thousandth of all, give way to the longest prefix.
HEAVY = 20_000
#: Suffix records that a reducer holds at once, about.
HELD = 400_000


def anchors(chunk: W.Chunk, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of ``length`` words in one row: their first words, rows, and anchors (first
    word of it), and the hashes of all PREFIX-word runs."""
    grams = W.gram_hashes(h, PREFIX)
    start, row = W.windows(chunk.first, length)
    if not len(start):
        return start, row, start, grams
    return start, row, first_least(grams, length - PREFIX + 1)[start], grams


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least value of each run of ``width`` stands, the first of equals. Runs
    double in length, so memory does not grow with the width."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        size += step
    return at


def suffix_trees(ids: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix trees of all groups at once, down to ``depth`` words. ids: words; start: where
    each suffix begins; group: its tree. Returns the suffixes in tree order and, for each,
    how many words it shares with the one before it (-1: another tree). Suffixes between
    which no number is below d hang below one node of d words."""
    columns = [ids[start + k] for k in range(depth)]
    keys = [(columns[k].astype(np.uint64) << np.uint64(32)) | (columns[k + 1] if k + 1 < depth else np.uint64(0)) for k in range(0, depth, 2)]
    order = np.lexsort((*keys[::-1], group))
    shared = np.full(len(order), -1, dtype=np.int64)
    same = group[order][1:] == group[order][:-1]
    shared[1:][same] = 0
    for c in columns:
        c = c[order]
        same &= c[1:] == c[:-1]
        shared[1:] += same
    return order, shared


def _runs(flag_doc: np.ndarray, at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts sorted positions into runs of consecutive ones: first index and size of each."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (flag_doc[1:] != flag_doc[:-1])
    for s in same:
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(at)))


def _texts(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _summed(key: np.ndarray, doc: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """Rows of equal neighbouring keys as one: the least document, and the sum of all |n|,
    below zero if one of them was or documents differ."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(first):
        return [pa.array(key), pa.array(doc), pa.array(n)]
    low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
    many = (low < high) | (np.minimum.reduceat(n, first) < 0)
    total = np.add.reduceat(np.abs(n), first)
    return [pa.array(key[first]), pa.array(low), pa.array(np.where(many, -total, total))]


_RECORD = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])


def spans(documents: DataFrame, length: int = 13, filter_bits: int = FILTER_BITS, heavy: int = HEAVY) -> DataFrame:
    """documents: doc_id, text. The words to remove: doc_id, th (hash of the text), low,
    high (words low..high-1), as a stored table. Spans of one text may touch or overlap."""
    spark = documents.sparkSession
    docs = _texts(documents)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per anchor of a chunk: its least document and the number of its suffixes,
        below zero if they are of more documents than one."""
        for batch in batches:
            for low, high, part in W.chunks(batch):
                chunk = W.Chunk(part)
                _, row, anchor, grams = anchors(chunk, chunk.hashes(), length)
                new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(anchor)))
                key, doc = grams[anchor[new]], batch.column(0).slice(low, high - low).to_numpy(zero_copy_only=False)[row[new]]
                order = np.argsort(key, kind="stable")
                key, doc, n = key[order], doc[order], n[order]
                yield pa.RecordBatch.from_arrays(_summed(key.view(np.int64), doc, n), names=["key", "doc_id", "n"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the key that may go on
        for batch in batches:
            key, doc, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if held is not None:
                key, doc, n = (np.concatenate(x) for x in zip(held, (key, doc, n), strict=True))
            if not len(key):
                continue
            key, doc, n = (c.to_numpy() for c in _summed(key, doc, n))
            held = key[-1:], doc[-1:], n[-1:]
            more = n[:-1] < 0
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][more]), pa.array(-n[:-1][more])], names=["key", "n"])
        if held is not None:
            more = held[2] < 0
            yield pa.RecordBatch.from_arrays([pa.array(held[0][more]), pa.array(-held[2][more])], names=["key", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "key long, doc_id long, n long").repartition(parts, "key").sortWithinPartitions("key")
    table = stored(counted.mapInArrow(repeated, "key long, n long"))
    total = table.agg(F.sum("n")).first()[0] or 0
    large = table.where(F.col("n") > max(heavy, total // 100_000)).select("key").toArrow()["key"].to_numpy()  # 100,000 keys at most
    large = np.sort(large.view(np.uint64))
    index = F.shiftrightunsigned("key", 64 - filter_bits)
    cells = table.select(index.alias("i")).selectExpr("shiftright(i, 6) as cell", "shiftleft(1L, cast(i & 63 as int)) as bit")
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^(filter_bits-6) rows at most
    bitmap = np.zeros(1 << (filter_bits - 6), dtype=np.uint64)
    bitmap[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast((bitmap, large))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, longest = shared.value
        for batch in batches:
            for low, high, part in W.chunks(batch):
                chunk = W.Chunk(part)
                h = chunk.hashes()
                start, row, anchor, grams = anchors(chunk, h, length)
                key = grams[anchor]
                i = key >> np.uint64(64 - filter_bits)
                use = np.flatnonzero((bits[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63))) & np.uint64(1))
                start, row, anchor, key = start[use], row[use], anchor[use], key[use]
                doc = batch.column("doc_id").slice(low, high - low).to_numpy(zero_copy_only=False)
                th = batch.column("th").slice(low, high - low).to_numpy(zero_copy_only=False)
                # what repeats within the chunk is settled here
                whole = grams[start]
                for k in [*range(PREFIX, length - PREFIX, PREFIX), length - PREFIX]:
                    whole = W.combine(whole, grams[start + k])
                _, one, inverse = np.unique(whole, return_index=True, return_inverse=True)
                for k in range(length):  # equal hashes of other words settle nothing
                    inverse = np.where((inverse >= 0) & (h[start + k] == h[start[one][inverse] + k]), inverse, -1)
                odd = np.flatnonzero(inverse < 0)
                inverse[odd] = len(one) + np.arange(len(odd))
                least = np.full(int(inverse.max(initial=-1)) + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, inverse, doc[row])
                gone = doc[row] > least[inverse]
                first, n = _runs(row[gone], start[gone])
                r, s = row[gone][first], start[gone][first]
                cut = [(key[gone][first]).view(np.int64), doc[r], th[r], (s - chunk.first[r]).astype(np.int32), (n + length - 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cut), pa.nulls(len(first), pa.binary())], schema=_RECORD)
                # the others go to the group of their prefix
                start, row, anchor, key, whole = (x[~gone] for x in (start, row, anchor, key, whole))
                big = np.zeros(len(key), dtype=bool)
                if len(longest) and len(key):
                    big = longest[np.minimum(np.searchsorted(longest, key), len(longest) - 1)] == key
                key = np.where(big, whole, key)
                first, n = _runs(row, start, anchor, key)
                r, s = row[first], start[first]
                ids = (h >> np.uint64(32)).astype("<u4")
                for a in range(0, len(first), 50_000):
                    b = slice(a, a + 50_000)
                    size = n[b] + length - 1
                    flat = ids[W.ranges(s[b], size)].tobytes()
                    ends = np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int32)
                    blob = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat)])
                    cols = [key[first[b]].view(np.int64), doc[r[b]], th[r[b]], (s[b] - chunk.first[r[b]]).astype(np.int32), n[b].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), blob], schema=_RECORD)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
            """Spans to remove, and the records that hold the least document of a node."""
            key, doc, th, at, n = (rows.column(c).to_numpy() for c in ("key", "doc_id", "th", "start", "n"))
            blob = rows.column("words").combine_chunks()
            offsets = np.frombuffer(blob.buffers()[1], dtype=np.int32)[blob.offset : blob.offset + len(blob) + 1]
            ids = np.frombuffer(blob.buffers()[2], dtype="<u4") if blob.buffers()[2] is not None else np.zeros(0, "<u4")
            record = np.repeat(np.arange(len(key)), n)
            begin = W.ranges(offsets[:-1].astype(np.int64) // 4, n.astype(np.int64))
            order, shared = suffix_trees(ids, begin, key[record], length)
            d = doc[record]
            first = np.flatnonzero(shared < length)
            node = np.cumsum(shared < length) - 1
            least = np.minimum.reduceat(d[order], first)[node] if len(node) else d
            gone = np.zeros(len(record), dtype=bool)
            gone[order] = d[order] > least
            place = W.ranges(at.astype(np.int64), n.astype(np.int64))
            first, size = _runs(record[gone], place[gone])
            r, s = record[gone][first], place[gone][first]
            out = pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(th[r]), pa.array(s), pa.array(s + size + length - 1)], names=["doc_id", "th", "low", "high"])
            stay = np.zeros(len(key), dtype=bool)
            stay[record[~gone]] = True
            return out, stay

        held: list[pa.Table] = []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            settled = rows.filter(pa.compute.is_null(rows["words"]))
            if len(settled):
                low, n = settled["start"].to_numpy().astype(np.int64), settled["n"].to_numpy()
                yield pa.RecordBatch.from_arrays([settled["doc_id"].combine_chunks(), settled["th"].combine_chunks(), pa.array(low), pa.array(low + n)], names=["doc_id", "th", "low", "high"])
            rows = rows.filter(pa.compute.is_valid(rows["words"]))
            if not len(rows):
                continue
            held.append(rows)
            if sum(map(len, held)) < 20_000:
                continue
            rows = pa.concat_tables(held).combine_chunks()
            last = rows["key"].to_numpy()
            cut = int(np.searchsorted(last, last[-1]))  # the last group may go on
            if cut:
                yield solve(rows.slice(0, cut).combine_chunks())[0]
                held = [rows.slice(cut)]
            elif len(rows) > HELD:  # one group: what is settled goes, the least documents stay
                out, stay = solve(rows)
                yield out
                held = [rows.filter(pa.array(stay))]
            else:
                held = [rows]
        if held:
            yield solve(pa.concat_tables(held).combine_chunks())[0]
        W.trim()

    sent = docs.mapInArrow(suffixes, "key long, doc_id long, th long, start int, n int, words binary")
    out = sent.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(trees, "doc_id long, th long, low long, high long")
    return stored(out)


def _with_spans(documents: DataFrame, **parameters) -> DataFrame:
    """Documents (as a struct) with their spans as a sorted array, null where there are none."""
    cut = spans(documents, **parameters).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("cuts"))
    keyed = documents.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_th", F.xxhash64(F.col("text").cast("string")))
    return keyed.join(cut.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "cuts"), ["_id", "_th"], "left")


def _gone(n: int, cuts: list | None) -> np.ndarray:
    mask = np.zeros(n, dtype=bool)
    for c in cuts or ():
        mask[c["low"] : c["high"]] = True
    return mask


def digests(documents: DataFrame, **parameters) -> DataFrame:
    """A row per row of documents: doc_id, n_words, n_removed, kept_sha256 (of the kept
    words joined by one space). Null and wordless texts have no words; repeated rows of
    one id never repeat each other; rows with a null id keep all words and take none."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, sha = [], [], []
            for text, cuts in zip(batch.column("text"), batch.column("cuts"), strict=True):
                own = (text.as_py() or "").encode().split()
                n.append(len(own))
                cuts = cuts.as_py()
                if cuts:
                    gone = _gone(len(own), cuts)
                    removed.append(int(gone.sum()))
                    own = [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                sha.append(hashlib.sha256(b" ".join(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _with_spans(documents.select("doc_id", F.col("text").cast("string").alias("text")), **parameters).select("doc_id", "text", "cuts")
    return rows.mapInArrow(kernel, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_text(text: str, cuts: list) -> str:
    """The text without the words of the spans; kept words keep the space between them."""
    data = text.encode()
    chunk = W.Chunk(pa.array([text], pa.large_string()))
    keep = np.flatnonzero(~_gone(len(chunk), cuts))
    first, size = _runs(np.zeros(len(keep), np.int64), keep)
    out = b""
    for a, k in zip(keep[first].tolist(), size.tolist(), strict=True):
        space = b"" if not out else b"\n" if b"\n" in data[chunk.end[a - 1] : chunk.start[a]] else b" "
        out += space + data[chunk.start[a] : chunk.end[a + k - 1]]
    return out.decode()


def deduplicated(documents: DataFrame, **parameters) -> DataFrame:
    """The documents with repeats cut out of their texts, all columns kept; n_chars, where
    there is one, is counted again. A text that loses all its words becomes empty."""
    names = documents.columns

    @F.udf("string", useArrow=True)
    def cut(text: str, spans_: list) -> str:
        return cut_text(text, spans_) if text is not None and spans_ else text  # it runs for every row

    rows = _with_spans(documents.select("doc_id", "text", F.struct(*[F.col(quoted(c)) for c in names]).alias("_row")), **parameters)
    text = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(cut(F.col("text").cast("string"), F.coalesce("cuts", F.array().cast("array<struct<low:long,high:long>>"))))
    out = rows.withColumn("_new", text)
    own = {c: F.col(f"_row.{quoted(c)}") for c in names}
    cols = [F.col("_new").alias("text") if c == "text" else F.when(F.col("cuts").isNull(), own[c]).otherwise(F.length("_new")).alias(c) if c == "n_chars" else own[c].alias(c) for c in names]
    return out.select(*cols)
