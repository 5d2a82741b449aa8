"""Benchmark decontamination: a prefix-filtered join of items into documents.

A window is ``length`` consecutive words of an item (a shorter item is one window).
Its shingles (runs of ``shingle`` words) are ordered by rarity, counted over all
documents. A window is contained in a document only if every shingle is, so the
necessary prefix is one shingle, the rarest. Documents meet windows on that
shingle; its place in the window fixes where the window would start and end
(positional and length bounds), and the words there are compared exactly.

Arrays are exploded with the outer variant, as the other one gets a filter that the
optimizer copies, lambdas and all, below the projection of the words.

DataFrame functions only. Each document's words stay one row until they meet the
windows; only matches are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import quoted, stored
from .url_filter import lower_ascii

#: Bytes between words: everything in ASCII but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of windows (words, items and shingles) that are sent to every executor at most;
#: more are joined by a shuffle, with the same result.
BROADCAST_BYTES = 64 << 20
_END = 0


def words_of(text: Column, between: str = BETWEEN) -> Column:
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), between), ""), F.array().cast("array<string>"))


def _hash(k: int, words: Column, i: Column) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)])


def _at(k: int, words: Column):
    return lambda i: _hash(k, words, i)


def _placed(k: int, words: Column):
    return lambda _, i: F.struct(i.alias("i"), _hash(k, words, i).alias("h"))


def benchmark_windows(items: DataFrame, length: int, between: str = BETWEEN) -> DataFrame:
    """items: item_id, text. A row per distinct window: wid, w (its words), items."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text"), between).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - length + 1, F.lit(1)))
    rows = w.where(F.size("all") > 0).select("item", "all", F.explode_outer(starts).alias("s")).select("item", F.slice("all", F.col("s"), length).alias("w"))
    return rows.groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("wid", F.xxhash64(F.concat_ws(" ", "w")))


def _shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """Each window's shingles: wid, h, off, k (fewer words where the window is shorter)."""
    per = []
    for k in range(1, shingle + 1):
        own = windows.where(F.size("w") == k if k < shingle else F.size("w") >= k)
        grams = F.transform(F.sequence(F.lit(0), F.size("w") - k), _at(k, F.col("w")))
        per.append(own.select("wid", F.posexplode_outer(grams).alias("off", "h"), F.lit(k).alias("k")))
    out = per[0]
    for x in per[1:]:
        out = out.unionByName(x)
    return out


def _grams(words: Column, ks: list[int]) -> Column:
    """All shingle hashes of a document: (i, h) structs."""
    each = [F.slice(F.transform(words, _placed(k, words)), 1, F.greatest(F.size(words) - (k - 1), F.lit(0))) for k in ks]
    return each[0] if len(each) == 1 else F.concat(*each)


def hits(documents: DataFrame, items: DataFrame, length: int = 10, shingle: int = 3, between: str = BETWEEN, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """documents: doc_id, text; items: item_id, text. A row per distinct (doc_id, text):
    doc_id, text_hash, n_words, spans (start and end of each occurrence, sorted) and
    items (ids as sorted strings). Null text has no words; repeated rows count once;
    items without words have no windows; windows of an item without an id hit, too, but are
    not listed; a null doc_id is an id like others; other columns
    are dropped."""
    windows = stored(benchmark_windows(items, length, between))
    strings = lambda c: F.octet_length(F.concat_ws("", c)) + 24 * F.size(c) + 48
    small = (windows.agg(F.sum(strings("w").cast("long") + strings("items") + 64 * F.size("w"))).first()[0] or 0) <= broadcast_bytes
    each = stored(_shingles(windows, shingle))
    ks = sorted(r["k"] for r in each.select("k").distinct().collect()) or [shingle]  # at most ``shingle`` values
    docs = documents.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), words_of(F.col("text").cast("string"), between).alias("words"))

    def sent(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if small else side

    seen = docs.select(F.explode_outer(F.transform(_grams(F.col("words"), ks), lambda g: g["h"])).alias("h"))
    counts = seen.join(sent(each.select("h").distinct()), "h").groupBy("h").agg(F.count("*").alias("n"))
    rarity = F.struct(F.coalesce(F.col("n"), F.lit(0)), F.col("h"), F.col("off"))
    prefix = stored(each.join(counts, "h", "left").groupBy("wid").agg(F.min_by(F.struct("h", "off"), rarity).alias("p")).select("wid", "p.h", "p.off"))

    # a last gram of every document meets a last window without words, so that documents without hits stay
    last = F.array(F.struct(F.size("words").alias("i"), F.lit(_END).cast("long").alias("h")))
    grams = docs.select("doc_id", "text_hash", "words", F.concat(_grams(F.col("words"), ks), last).alias("g"))
    spark = documents.sparkSession
    if small:
        table = prefix.join(windows, "wid").select("h", "off", "w", "items")
        end = spark.createDataFrame([(_END, 0, [], [])], "h long, off int, w array<string>, items array<string>")
        flat = grams.select("doc_id", "text_hash", "words", F.explode_outer("g").alias("g"))
        start = F.col("g.i") - F.col("off")
        met = flat.join(F.broadcast(table.unionByName(end)), F.col("g.h") == F.col("h"))
        met = met.where((start >= 0) & (start + F.size("w") <= F.size("words")))
        met = met.where(F.slice("words", start + 1, F.size("w")) == F.col("w"))
        found = met.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), start.alias("start"), (start + F.size("w")).alias("end"), "items")
    else:
        flat = grams.select("doc_id", "text_hash", F.size("words").alias("n"), F.explode_outer("g").alias("g")).select("doc_id", "text_hash", "n", "g.i", "g.h")
        ends = flat.where(F.col("h") == _END).select("doc_id", "text_hash", F.col("n").cast("long").alias("n_words"), F.col("n").alias("start"), F.col("n").alias("end"), F.array().cast("array<string>").alias("items"))
        start = F.col("i") - F.col("off")
        near = flat.join(prefix.join(windows.select("wid", F.size("w").alias("len")), "wid"), "h").where((start >= 0) & (start + F.col("len") <= F.col("n")))
        near = near.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(start.alias("start"), "wid")).alias("c"))
        same = F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("text_hash") == F.col("near_hash"))
        back = docs.join(near.select(F.col("doc_id").alias("near_id"), F.col("text_hash").alias("near_hash"), "c"), same).select("doc_id", "text_hash", "words", F.explode_outer("c").alias("c"))
        met = back.select("doc_id", "text_hash", "words", "c.start", "c.wid").join(windows, "wid").where(F.slice("words", F.col("start") + 1, F.size("w")) == F.col("w"))
        found = ends.unionByName(met.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), "start", (F.col("start") + F.size("w")).alias("end"), "items"))
    spans = F.collect_set(F.when(F.col("end") > F.col("start"), F.struct("start", "end")))
    names = F.array_distinct(F.flatten(F.collect_set("items")))
    return found.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.sort_array(spans).alias("spans"), F.sort_array(names).alias("items"))


def covered(spans: Column) -> Column:
    """Words inside sorted spans, each once."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e"))
    return F.aggregate(
        spans, zero,
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["e"], x["start"]))).cast("long").alias("n"), F.greatest(a["e"], x["end"].cast("long")).alias("e")),
        lambda a: a["n"],
    )


def contamination(documents: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """A row per distinct (doc_id, text): doc_id, n_words, n_hit (words inside any
    occurrence of a window), n_items, items_sha256, contaminated, text_hash."""
    found = hits(documents, items, **parameters).withColumn("n_hit", covered(F.col("spans")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "text_hash",
    )


def decontaminated(documents: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """The documents without a hit, all columns kept."""
    bad = contamination(documents, items, **parameters).where("contaminated").select("doc_id", "text_hash")
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_bad"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_bad"))
    rows = documents.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("_h"), F.struct(*[F.col(quoted(c)) for c in documents.columns]).alias("_row"))
    return rows.join(bad, same, "left_anti").select(*[F.col(f"_row.{quoted(c)}").alias(c) for c in documents.columns])
