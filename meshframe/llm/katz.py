"""LM scoring: a Katz backoff model of any order over all tokens of a corpus.

    P(w | h) = d(c) c / c(h)      where the n-gram (h, w) was counted c > 0 times
             = alpha(h) P(w | h') otherwise: h' is h without its farthest word, and
                                  alpha is 1 for a history never met
    P(w)     = d'(c) c / N        for a word counted c times, and what that leaves
                                  for all unknown words together

and so on down to the word alone. Each order has its own Good-Turing discounts for
counts up to ``K``; higher counts give up ``DELTA`` each, so every history keeps some
mass, and alpha(h) hands exactly that mass to the words not met after h. A begin mark
stands before a text and an end token after it; the first tokens of a text have the
shorter histories that there are. Words are told by 64-bit hashes, words of histories
by the first 48 bits of theirs, histories of several words by 48 bits of a hash.

Counts, weights and evaluation are partitioned by hash, never gathered:

1. ``unigrams``: a stored table of word counts.
2. Every chunk of texts sends its n-grams, sorted and packed, to buckets by word, with
   the texts that hold them. A word with more tokens than a bucket is meant for is split
   over the buckets by its histories. So each bucket has all counts of its n-grams of
   every order. Buckets are filled in ``PASSES`` turns, each of which reads the texts
   again, so that only a part of what is sent stands on disk at once.
3. A bucket evaluates its tokens as far as it can: each goes down from its longest
   history to the first n-gram that was counted. Log scores are sums, and where the
   discounts or alpha(h) are still unknown it sends what they apply to: how many tokens
   have an n-gram counted once, twice, ...; the masses of its n-grams by history; and,
   for tokens that back off, the histories they pass, packed. These are stored tables,
   partitioned by kind.
4. Histories and the tokens that passed them meet in buckets by the nearest word. Such a
   bucket has log c(h) and log alpha(h) c(h), and gives what they add to each text; the
   parts of each text's score are added.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import discard, settings, stored

#: Words of the longest n-gram of the registered query.
ORDER = 3
#: Highest count that Good-Turing discounts.
K = 5
#: What higher counts give up.
DELTA = 0.01
#: Tokens of a bucket, about.
PER_BUCKET = 1_200_000
#: Entries of a bucket that are expanded at once.
AT_ONCE = 200_000
#: Bytes of text that send their pairs together.
SEND_BYTES = 5 << 20
#: log2 of the bits of the bitmap of histories that stand in held-out texts (4 MB).
FILTER_BITS = 25
#: Bytes of a batch on its way to Python: one chunk, not thousands of rows of any length.
BATCH_BYTES = 19 * SEND_BYTES // 20
#: Turns in which buckets are filled.
PASSES = 3

END, BEGIN, NONE = np.uint64(0x0F0E0D0C0B0A0908), np.uint64(0x1716151413121110), np.uint64(0)


def discounts(n: list[int]) -> np.ndarray:
    """n: how many types were counted 1, 2, ... K+1 times. The factor for each count
    0..K (0 unused): Katz's, from Turing's estimates r* = (r+1) n(r+1) / n(r). Where one
    of them is no discount, as copies in a corpus make n(r) uneven, all come from a line
    through log n(r) (simple Good-Turing); without two such points, a half is taken off."""
    r = np.arange(1, K + 1)
    counts = np.array(n[: K + 1], dtype=float)
    if (counts > 0).all():
        stars = (r + 1) * counts[1:] / counts[:-1] / r
        mu = (K + 1) * counts[K] / counts[0]
        turing = (stars - mu) / (1 - mu) if mu < 1 else np.zeros(K)
        if ((turing > 0) & (turing < 1)).all():
            return np.concatenate([[0.0], turing])
    have = np.flatnonzero(counts > 0)
    if len(have) > 1:
        slope = np.polyfit(np.log(have + 1), np.log(counts[have]), 1)[0]
        if slope < -1.05:
            return np.concatenate([[0.0], ((r + 1) / r) ** (slope + 1)])
    return np.concatenate([[0.0], (r - 0.5) / r])


def kept(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    c = np.asarray(c, dtype=float)
    return np.where(c > K, c - DELTA, d[np.minimum(c, K).astype(int)] * c)


def tokens(chunk: W.Chunk, order: int = 2) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Word, the ``order`` - 1 words before it (nearest first, 48 bits of their hashes)
    and row of each token of a chunk, ends included. One begin mark stands before a
    text, and ``NONE`` before that."""
    h = chunk.hashes()
    rows = np.arange(chunk.rows)
    count = np.diff(chunk.first)
    word = np.empty(len(h) + chunk.rows, dtype=np.uint64)
    word[np.arange(len(h)) + chunk.doc] = h
    word[chunk.first[1:] + rows] = END
    before, last, start = [], word >> np.uint64(16), BEGIN >> np.uint64(16)
    for _ in range(order - 1):
        shifted = np.empty_like(word)
        shifted[1:] = last[:-1]
        shifted[chunk.first[:-1] + rows] = start
        before.append(shifted)
        last, start = shifted, NONE
    return word, before, np.repeat(rows, count + 1)


def histories(before: list[np.ndarray]) -> list[np.ndarray]:
    """The key of each token's history for the orders 2, 3, ...: its order above 48 bits
    of a hash of all its words; 0 where the text begins too late for it."""
    out, h = [], before[0]
    for k, b in enumerate(before):
        h = W.combine(h, b) >> np.uint64(16) if k else h
        out.append(np.where(b != NONE, h | np.uint64((k + 2) << 48), np.uint64(0)))
    return out


def _placed(h: np.ndarray) -> np.ndarray:
    """np.argsort of 64-bit hashes, equal ones in order: sorts numbers of which the low
    bits are places, which is several times as fast."""
    low = np.uint64((1 << max(len(h) - 1, 1).bit_length()) - 1)
    packed = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64))
    rank = (packed & low).astype(np.int64)
    x = h[rank]
    if ((x[1:] != x[:-1]) & ((packed[1:] ^ packed[:-1]) <= low)).any():  # two differ in these low bits only
        return np.argsort(h, kind="stable")
    return rank


def ranked(word: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """np.lexsort of n-grams: by word, then by the words before it, nearest first."""
    rank = None
    for x in (*(b << np.uint64(16) for b in before[::-1]), word):  # 48 bits, moved up
        rank = _placed(x) if rank is None else rank[_placed(x[rank])]
    return rank


def _input(documents: DataFrame, train) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(True)).alias("train"))


def unigrams(docs: DataFrame) -> DataFrame:
    """A row per word: w (hash), c (tokens in training texts), other (in held-out ones)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            w = np.concatenate([x[0] for x in held])
            u, inv = np.unique(w, return_inverse=True)
            c, o = (np.bincount(inv, weights=np.concatenate([x[k] for x in held]), minlength=len(u)).astype(np.int64) for k in (1, 2))
            held[:] = [(u, c, o)]
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c), pa.array(o)], names=["w", "c", "other"])

        for batch in batches:
            for low, high, part in W.chunks(batch):
                chunk = W.Chunk(part, lower=True)
                word, _, row = tokens(chunk)
                train = batch.column("train").slice(low, high - low).to_numpy(zero_copy_only=False)[row]
                u, inv = np.unique(word, return_inverse=True)
                held.append((u, np.bincount(inv, weights=train), np.bincount(inv, weights=~train)))
                if sum(len(x[0]) for x in held) > 1_500_000:
                    out = flush()
                    if len(out) > 1_000_000:
                        yield out
                        held.clear()
        if held:
            yield flush()

    return stored(docs.mapInArrow(count, "w long, c long, other long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("other").alias("other")))


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """keys: key. A bitmap of the top ``bits`` bits; its size is fixed."""
    cells = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("i")).selectExpr("shiftright(i, 6) as cell", "shiftleft(1L, cast(i & 63 as int)) as bit")
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _held_out(docs: DataFrame, order: int, bits: int) -> np.ndarray:
    """A bitmap of the histories of held-out tokens; its size is fixed."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << (bits - 6), dtype=np.uint64)
        for batch in batches:
            for _, _, part in W.chunks(batch):
                _, before, _ = tokens(W.Chunk(part, lower=True), order)
                for h in histories(before):
                    at = W.mix(h[h > 0]) >> np.uint64(64 - bits)
                    np.bitwise_or.at(cells, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        blocks = cells.reshape(-1, min(len(cells), 4096))
        have = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array([blocks[i].tobytes() for i in have], pa.binary())], names=["block", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        bits = functools.reduce(np.bitwise_or, (np.frombuffer(x.as_buffer(), np.uint64) for x in table["bits"]))
        return pa.table({"block": table["block"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    found = docs.where("not train").select("text").mapInArrow(mark, "block long, bits binary").groupBy("block").applyInArrow(merge, "block long, bits binary").toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for i, x in zip(found["block"].to_pylist(), found["bits"].to_pylist(), strict=True):
        x = np.frombuffer(x, np.uint64)
        out[i * len(x) : (i + 1) * len(x)] = x
    return out


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = W.mix(h) >> np.uint64(64 - (len(bits).bit_length() + 5))
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def _columns(order: int) -> list[str]:
    """What is sent: words; for each word of history, how many there are and their two
    parts; how many texts hold each n-gram, which, and how often."""
    return ["w", *(f"{c}{k}" for k in range(order - 1) for c in ("n", "low", "high")), "texts", "row", "times"]


_OUT = pa.schema([("kind", pa.string()), ("h", pa.int64()), ("chunk", pa.int64()), ("idx", pa.int32()), ("n", pa.int64()), ("payload", pa.binary())])
_OUT_DDL = "kind string, h long, chunk long, idx int, n long, payload binary"


def _by_history(h: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct histories and the sums of each value."""
    hs, inv = np.unique(h, return_inverse=True)
    return [hs, *(np.bincount(inv, weights=v, minlength=len(hs)) for v in values)]


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts in one byte each, or in two or four where one is larger."""
    most = x.max(initial=0)
    return x.astype("u1" if most < 256 else "<u2" if most < 65536 else "<u4")


def _rows(size: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _OUT], schema=_OUT)


def _masses(c: np.ndarray) -> list[np.ndarray]:
    """What the discounted counts are made of: which are 1, 2, ... K, and the rest."""
    return [*((c == r).astype(float) for r in range(1, K + 1)), np.where(c > K, c - DELTA, 0.0)]


#: Columns of a history: key, key of the one below, tokens, its n-grams' ``_masses``,
#: those of the same n-grams one order below, and the mass of words alone.
_HISTORY = 4 + 2 * (K + 1)


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length; counts are narrowed."""
    columns = [x if x.dtype == np.uint64 or x.min(initial=0) < 0 or x.max(initial=0) >= 2**32 or (x != np.floor(x)).any() else _narrow(x) for x in columns]
    return np.int64(len(columns[0])).tobytes() + b"".join(x.dtype.str.encode() + x.tobytes() for x in columns)


def _unpack(payload: bytes) -> list[np.ndarray]:
    size, at, out = int(np.frombuffer(payload, "<i8", 1)[0]), 8, []
    while at < len(payload):
        t = np.dtype(payload[at : at + 3].decode())
        out.append(np.frombuffer(payload, t, size, at + 3))
        at += 3 + size * t.itemsize
    return out


def _handed(found: DataFrame, d: list[np.ndarray], hot48: np.ndarray, hot_counts: np.ndarray) -> DataFrame:
    """found: h (a bucket that holds the histories of some nearest words), kind, payload:
    histories, and the backed-off tokens that passed them. A row per chunk with such
    tokens: chunk, payload (which texts, and what c(h) and alpha(h) add to each)."""

    def weigh(table: pa.Table) -> pa.Table:
        sent = {kind: [_unpack(x) for k, x in zip(table["kind"].to_pylist(), table["payload"].to_pylist(), strict=True) if k == kind] for kind in ("histories", "backoff")}
        parts, passed = sent["histories"], sent["backoff"]
        if not parts or not passed:  # nothing met, so alpha is 1, or nobody asks
            return pa.table({"chunk": pa.array([], pa.int64()), "payload": pa.array([], pa.binary())})
        key = np.concatenate([p[0] for p in parts])
        keys, first = np.unique(key, return_index=True)
        lower = np.concatenate([p[1] for p in parts])[first]
        sums = _by_history(key, *(np.concatenate([p[k] for p in parts]).astype(float) for k in range(2, _HISTORY)))[1:]
        n, own, below, mass = sums[0], sums[1 : K + 2], sums[K + 2 : 2 * K + 3], sums[-1]
        order = (keys >> np.uint64(48)).astype(np.int64)
        met, rest = np.zeros(len(keys)), 1 - mass
        for k in range(2, len(d) + 1):
            at = np.flatnonzero(order == k)
            if not len(at):
                continue
            met[at] = own[K][at] + sum(r * d[k - 1][r] * own[r - 1][at] for r in range(1, K + 1))
            if k > 2:  # c(h') of the history below, which is here too, or is a split word
                low = lower[at]
                where = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
                c = np.where(keys[where] == low, n[where], 1.0)
                if len(hot48) and k == 3:
                    word = low & np.uint64(2**48 - 1)
                    where = np.minimum(np.searchsorted(hot48, word), len(hot48) - 1)
                    c = np.where(hot48[where] == word, hot_counts[where], c)
                rest[at] = 1 - (below[K][at] + sum(r * d[k - 2][r] * below[r - 1][at] for r in range(1, K + 1))) / c
        h, task, serial, idx, gone, less = (np.concatenate([p[k] for p in passed]) for k in range(6))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        known = keys[at] == h
        count, hand = np.log10(n), np.log10(np.maximum(n - met, 1e-12) / np.maximum(rest, 1e-12))
        adds = np.where(known, gone * hand[at] - less * count[at], 0.0)
        chunks, which = np.unique((task.astype(np.int64) << 32) | serial.astype(np.int64), return_inverse=True)
        own, which = np.unique(which * 32768 + idx, return_inverse=True)
        adds = np.bincount(which, weights=adds, minlength=len(own))
        cuts = np.searchsorted(own, np.arange(len(chunks) + 1) * 32768)
        payload = [_pack([own[i:j] % 32768, adds[i:j]]) for i, j in zip(cuts, cuts[1:], strict=False)]
        W.trim()
        return pa.table({"chunk": pa.array(chunks), "payload": pa.array(payload, pa.binary())})

    return stored(found.groupBy("h").applyInArrow(weigh, "chunk long, payload binary"))


def scores(documents: DataFrame, train=None, filter_bits: int = FILTER_BITS, order: int = 2, passes: int = PASSES, per_bucket: int | None = None) -> DataFrame:
    """documents: doc_id, text; train: a boolean column, which texts the model learns
    from (null: learns); order: words of the longest n-gram, 2 or more. A row per row of
    documents: doc_id, held_out, n_tokens, n_known (tokens whose word training knows),
    train_tokens, base_score (add-0.1 unigrams), score (the model's log10 probability of
    the text), vocabulary.

    A null or wordless text is its end token. Repeated rows are trained on and scored
    each. Without training texts every word is unknown and all scores are 0. The texts
    are read in several passes; if these find other rows or another order of them, it
    raises an error."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    per_bucket = per_bucket or PER_BUCKET
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) != 0 if train is None else train
    docs = _input(documents, train)
    small = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    with settings(documents.sparkSession, small):
        uni = unigrams(docs)
    stats = uni.agg(F.sum("c").alias("N"), F.count_if(F.col("c") > 0).alias("V"), F.sum("other").alias("O"), *[F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, K + 2)]).first()
    n_train, vocabulary, held = stats["N"] or 0, stats["V"] or 0, stats["O"] or 0
    d1 = discounts([stats[f"n{r}"] for r in range(1, K + 2)])
    mass = uni.where("c > 0").agg(F.sum(F.when(F.col("c") > K, F.col("c") - DELTA).otherwise(F.element_at(F.array(*map(F.lit, d1[1:].tolist())), F.greatest(F.least(F.col("c"), F.lit(K)), F.lit(1)).cast("int")) * F.col("c")))).first()[0] or 0.0
    unknown = 1 - mass / n_train if n_train else 1.0
    hot = {r["w"] % 2**64: r["c"] for r in uni.where(F.col("c") + F.col("other") > min((n_train + held) / 64, per_bucket)).collect()}  # of as many words as buckets, or 64, at most
    discard(uni)
    buckets = max(1, -(-(n_train + held) // per_bucket))
    passes = max(1, min(passes, buckets))
    hot_words, hot_counts = np.array(sorted(hot), dtype=np.uint64), np.array([hot[w] for w in sorted(hot)], dtype=np.float64)
    hot48 = hot_words >> np.uint64(16)
    with settings(documents.sparkSession, small):
        marked = _held_out(docs, order, filter_bits)
    shared = documents.sparkSession.sparkContext.broadcast((marked, hot_words, hot_counts))
    columns = _columns(order)
    packed = "bucket int, chunk long, " + ", ".join(f"{c} binary" for c in columns)
    levels = range(2, order + 1)

    def send(turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words = shared.value[1]
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, part in W.chunks(batch, limit=SEND_BYTES):
                for low in range(a, b, 32768):
                    n = min(b - low, 32768)
                    chunk = W.Chunk(part.slice(low - a, n), lower=True)
                    word, before, row = tokens(chunk, order)
                    ids = batch.column("doc_id").slice(low, n)
                    trains = batch.column("train").slice(low, n).to_numpy(zero_copy_only=False)
                    serial += 1
                    # what the chunk's rows are, for the end, and what tells that each pass met the same
                    sums = np.zeros(n, dtype=np.uint64)
                    np.add.at(sums, row, W.mix(word + before[0]))
                    own = [np.asarray(ids.fill_null(0), dtype="<i8"), (np.diff(chunk.first) + 1).astype("<i8"), trains.astype("u1") | (np.asarray(ids.is_null()).astype("u1") << 1), sums]
                    own = [x.tobytes() for x in own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([-1 - serial % 1_000_003], pa.int32()), pa.array([serial], pa.int64()), *[pa.array([x], pa.binary()) for x in own], *[pa.nulls(1, pa.binary())] * (len(columns) - 4)],
                        names=["bucket", "chunk", *columns],
                    )
                    to = W.mix(word ^ W._K3)
                    if len(hot_words):
                        is_hot = hot_words[np.minimum(np.searchsorted(hot_words, word), len(hot_words) - 1)] == word
                        to[is_hot] = W.combine(word[is_hot], before[0][is_hot])
                    to = (to % np.uint64(buckets)).astype(np.int32)
                    if passes > 1:
                        keep = to % passes == turn
                        to, word, row, before = to[keep], word[keep], row[keep], [x[keep] for x in before]
                    if not len(to):
                        continue
                    rank = ranked(word, before)  # rows stay in order
                    rank = rank[np.argsort((to.astype(np.int16) if buckets < 2**15 else to)[rank], kind="stable")]
                    to, word, row, before = to[rank], word[rank], row[rank], [x[rank] for x in before]
                    change = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
                    at = change(to)
                    starts = np.flatnonzero(at)
                    at = at | change(word)
                    firsts = [np.flatnonzero(at)]  # of each word, each history word, each text
                    for x in before:
                        at = at | change(x)
                        firsts.append(np.flatnonzero(at))
                    firsts.append(np.flatnonzero(at | change(row)))
                    # how many of the next there are in each
                    inner = [np.diff(np.append(np.searchsorted(y, x), len(y))).astype("<u4") for x, y in zip(firsts, firsts[1:], strict=False)]
                    e = firsts[-1]
                    parts = [(word[firsts[0]], 0)]
                    for k, x in enumerate(before):
                        x = x[firsts[k + 1]]
                        parts += [(inner[k], k), ((x & np.uint64(0xFFFFFFFF)).astype("<u4"), k + 1), ((x >> np.uint64(32)).astype("<u2"), k + 1)]
                    parts += [(inner[-1], order - 1), ((row[e] | (trains[row[e]].astype(np.int64) << 15)).astype("<u2"), order), (np.diff(np.append(e, len(to))).astype("<u4"), order)]
                    cuts = [np.searchsorted(x, np.append(starts, len(to))) for x in firsts]
                    cols = [[x[cuts[k][i] : cuts[k][i + 1]].tobytes() for i in range(len(starts))] for x, k in parts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to[starts], pa.int32()), pa.array([serial] * len(starts), pa.int64()), *[pa.array(c, pa.binary()) for c in cols]],
                        names=["bucket", "chunk", *columns],
                    )

    def met(keep: np.ndarray, key: np.ndarray, lower: np.ndarray, near: np.ndarray, c: np.ndarray, below: list[np.ndarray], mass: np.ndarray) -> list[np.ndarray]:
        """The histories of some n-grams, with the bucket they go to."""
        key, lower, near, c = key[keep], lower[keep], near[keep], c[keep]
        keys, first, inv = np.unique(key, return_index=True, return_inverse=True)
        total = lambda v: np.bincount(inv, weights=v, minlength=len(keys))
        return [near[first], keys, lower[first], total(c), *map(total, _masses(c)), *(total(x[keep]) for x in below), total(mass[keep])]

    def home(before: np.ndarray, keys: list[np.ndarray], j: int, at: np.ndarray) -> np.ndarray:
        """The buckets of the histories of order j of some n-grams: by the nearest word, or,
        of a split word, by the nearest two."""
        near = before[at]
        to = W.mix(near)
        if len(hot_words):
            at48 = hot_words >> np.uint64(16)
            split = at48[np.minimum(np.searchsorted(at48, near), len(at48) - 1)] == near
            to[split] = W.mix((keys[1] if j > 2 else keys[0])[at[split]])
        return (to % np.uint64(buckets)).astype(np.int64)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot_words, hot_counts = shared.value
        table = pa.Table.from_batches(batches)
        chunk_of = table["chunk"].to_numpy()
        if table["bucket"][0].as_py() < 0:
            for i in range(len(table)):
                payload = b"".join(np.int64(len(x)).tobytes() + x for x in (table[c][i].as_py() for c in columns[:4]))
                yield _rows(1, kind=["rows"], chunk=[int(chunk_of[i])], payload=[payload])
            return
        read = lambda c, t: [np.frombuffer(x.as_buffer(), dtype=t) if len(x.as_buffer()) else np.zeros(0, t) for x in table[c]]
        w_of, texts, e_row, e_times = (read(c, t) for c, t in (("w", "<u8"), ("texts", "<u4"), ("row", "<u2"), ("times", "<u4")))
        inner = [read(f"n{k}", "<u4") for k in range(order - 1)] + [texts]
        low, high = ([read(f"{c}{k}", t) for k in range(order - 1)] for c, t in (("low", "<u4"), ("high", "<u2")))
        ends = lambda x: np.concatenate([np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)])
        inner_ends = [[ends(x) for x in xs] for xs in inner]
        size = 1 + max((int(x.max()) & 32767 for x in e_row if len(x)), default=0)
        parts: list[list[np.ndarray]] = []  # by text that has tokens here: its number and sums
        few, pairs, passed = np.zeros((order + 1, K + 2), dtype=np.int64), [], []
        slices = max(1, -(-sum(map(len, e_row)) // AT_ONCE))

        def told(found: list[np.ndarray], kind: str = "histories") -> Iterator[pa.RecordBatch]:
            to, *cols = found
            rank = np.lexsort((cols[0], cols[1], to) if kind == "histories" else (cols[0], to))
            to, cols = to[rank], [x[rank] for x in cols]
            at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
            stops = np.append(at, len(to))
            yield _rows(len(at), kind=[kind] * len(at), h=to[at], payload=[_pack([x[i:j] for x in cols]) for i, j in zip(stops, stops[1:], strict=False)])

        for k in range(slices):  # words in order of their hashes, so that a bucket is never whole in memory
            edge = [np.uint64(min(2**64 - 1, 2**64 * x // slices)) for x in (k, k + 1)]
            a = [int(np.searchsorted(w, edge[0])) for w in w_of]
            b = [int(np.searchsorted(w, edge[1])) if k + 1 < slices else len(w) for w in w_of]
            cut = lambda x, lo, hi: np.concatenate([v[lo[i] : hi[i]] for i, v in enumerate(x)])
            nested = [cut(w_of, a, b)]  # the word, then the words before it, of each n-gram
            if not len(nested[0]):
                continue
            for j in range(order - 1):
                count = cut(inner[j], a, b)
                a, b = ([int(inner_ends[j][i][x]) for i, x in enumerate(y)] for y in (a, b))
                nested = [np.repeat(x, count) for x in nested]
                nested.append(cut(low[j], a, b).astype(np.uint64) | (cut(high[j], a, b).astype(np.uint64) << np.uint64(32)))
            e_gram = np.repeat(np.arange(len(nested[0])), cut(texts, a, b))
            a, b = ([int(inner_ends[-1][i][x]) for i, x in enumerate(y)] for y in (a, b))
            rows = cut(e_row, a, b).astype(np.int64)
            times = cut(e_times, a, b).astype(np.float64)
            chunk_at = np.repeat(np.arange(len(chunk_of)), [y - x for x, y in zip(a, b, strict=True)])
            train_, rows = rows >> 15, rows & 32767
            # types of each order: which one an n-gram is, and a place where each stands
            rank = ranked(nested[0], nested[1:])
            new, type_of, place = np.zeros(len(rank), dtype=bool), [], []
            new[:1] = True
            for x in nested:
                y = x[rank]
                new[1:] |= y[1:] != y[:-1]
                t = np.empty(len(rank), np.int64)
                t[rank] = np.cumsum(new) - 1
                type_of.append(t)
                place.append(rank[new])
            counts = [np.bincount(type_of[-1][e_gram], weights=times * train_, minlength=len(place[-1]))]
            for j in range(order - 2, -1, -1):
                counts.insert(0, np.bincount(type_of[j][place[j + 1]], weights=counts[0], minlength=len(place[j])))
            words_ = nested[0][place[0]]
            if len(hot_words):
                at = np.minimum(np.searchsorted(hot_words, words_), len(hot_words) - 1)
                is_hot = hot_words[at] == words_
                counts[0][is_hot] = hot_counts[at[is_hot]]
            keys = histories(nested[1:])
            for j in range(1, order):  # an n-gram that would begin before its text is none
                counts[j][keys[j - 1][place[j]] == 0] = 0
            c_word = counts[0]
            p_word = np.where(c_word > 0, kept(c_word, d1) / max(n_train, 1), unknown)
            # each token's order: the longest there is, and the longest that was counted
            types = [t[e_gram] for t in type_of]
            c = [x[t] for x, t in zip(counts, types, strict=True)]
            longest, found = np.ones(len(rows), np.int64), np.ones(len(rows), np.int64)
            score = np.log10(np.maximum(p_word, 1e-300))[types[0]]
            charge = np.log10(np.maximum(c_word, 1))[types[0]]
            for j in range(1, order):
                longest[keys[j - 1][e_gram] > 0] = j + 1
                have = c[j] > 0
                found[have] = j + 1
                score[have] = np.where(c[j][have] > K, np.log10(np.maximum(c[j][have] - DELTA, 0.5)), 0.0)
                if j < order - 1:  # as the history of the next token, with all words it can have
                    charge = np.where(keys[j - 1][e_gram] > 0, np.log10(np.maximum(c[j], 1)), charge)
            charge[nested[0][e_gram] == END] = 0.0
            key = chunk_at * size + rows
            own, at = np.unique(key, return_inverse=True)
            total = lambda v: np.bincount(at, weights=v, minlength=len(own))  # noqa: E731, B023
            lows = (total(times * ((found == j) & (c[j - 1] == r))) for j in levels for r in range(1, K + 1))
            parts.append([own, total(times * np.log10(c_word + 0.1)[types[0]]), total(times * (score - charge)), *map(_narrow, (total(times * (c[0] > 0)), *lows))])
            # histories: mass of their n-grams
            for j in levels:
                h = keys[j - 2][place[j - 1]]
                keep = (counts[j - 1] > 0) & (h > 0)
                keep[keep] = _marked(bits, h[keep])
                below = counts[j - 2][type_of[j - 2][place[j - 1]]]
                near_to = home(nested[1], keys, j, place[j - 1])
                none = np.zeros(len(h))
                if j == 2:
                    pairs.append(met(keep, h, np.zeros_like(h), near_to, counts[1], [none] * (K + 1), p_word[type_of[0][place[1]]]))
                else:
                    yield from told(met(keep, h, keys[j - 3][place[j - 1]], near_to, counts[j - 1], _masses(below), none))
            # the histories that tokens pass on their way down, and how many tokens have each low count
            for j in levels:
                off = np.flatnonzero((longest >= j) & (found < longest) & (found <= j))
                n, gram, chunk = times[off], e_gram[off], chunk_of[chunk_at[off]]
                passed.append([
                    home(nested[1], keys, j, gram), keys[j - 2][gram], *map(_narrow, (chunk >> 32, chunk & 0xFFFFFFFF, rows[off], np.where(found[off] < j, n, 0), np.where(longest[off] > j, n, 0)))
                ])
                few[j] += np.array([(counts[j - 1] == r).sum() for r in range(K + 2)])
        if pairs:
            to, key, _, *sums = (np.concatenate(x) for x in zip(*pairs, strict=True))
            _, first = np.unique(key, return_index=True)
            hs, *sums = _by_history(key, *sums)
            yield from told([to[first], hs, np.zeros_like(hs), *sums])
        if passed:
            yield from told([np.concatenate(x) for x in zip(*passed, strict=True)], "backoff")
        for j in levels:
            yield _rows(K + 1, kind=["counts"] * (K + 1), h=np.full(K + 1, j), idx=np.arange(1, K + 2, dtype=np.int32), n=few[j][1:])
        own, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        sums = []
        for k in range(1, len(parts[0])):
            x = np.bincount(at, weights=np.concatenate([p[k] for p in parts]), minlength=len(own))
            sums.append(x if k < 3 else _narrow(x))
        cuts = np.searchsorted(own, np.arange(len(chunk_of) + 1) * size)
        payloads = []
        for i in range(len(chunk_of)):
            s = slice(cuts[i], cuts[i + 1])
            payloads.append(_pack([(own[s] - i * size).astype("<u2"), *(x[s] for x in sums)]))
        yield _rows(len(payloads), kind=["texts"] * len(payloads), chunk=chunk_of, payload=payloads)
        W.trim()

    with settings(documents.sparkSession, small):
        turns = [stored(docs.mapInArrow(functools.partial(send, turn), packed).groupBy("bucket").applyInArrow(evaluate, _OUT_DDL), "kind") for turn in range(passes)]

    def drop(kind: str) -> None:
        for table in turns:
            part = table.where(F.col("kind") == kind)
            part.stored_at = f"{table.stored_at}/kind={kind}"
            discard(part)

    model = functools.reduce(lambda x, y: x.unionAll(y), turns)
    seen = {(r["h"], r["idx"]): r["n"] for r in model.where("kind = 'counts'").groupBy("h", "idx").agg(F.sum("n").alias("n")).collect()}
    d = [d1, *(discounts([seen.get((j, r), 0) for r in range(1, K + 2)]) for j in levels)]
    met_ = model.where("kind in ('histories', 'backoff')").select("h", "kind", "payload")
    # in turns too, so that only a part of the histories is in a shuffle
    with settings(documents.sparkSession, small):
        handed = [_handed(met_.where(F.col("h") % passes == turn), d, hot48, hot_counts) for turn in range(passes)]
    drop("histories")
    drop("backoff")
    begun = docs.where("train").count()
    at_begin = -float(np.log10(begun)) if begun else 0.0
    low_logs = [float(np.log10(x[r] * r)) for x in d[1:] for r in range(1, K + 1)]
    norm = float(np.log10(n_train + 0.1 * (vocabulary + 1)))

    def finish(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_pylist()
        payload = table["payload"].to_pylist()
        told = [x for k, x in zip(kind, payload, strict=True) if k == "rows"]
        if len(told) != passes or len(set(told)) > 1:
            raise RuntimeError("the texts differ between two readings: store them first")
        out, at = [], 0
        for t in ("<i8", "<i8", "u1"):
            size = int(np.frombuffer(told[0], "<i8", 1, at)[0])
            out.append(np.frombuffer(told[0][at + 8 : at + 8 + size], t))
            at += 8 + size
        ids, n, flags = out
        known, base, score = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.full(len(ids), at_begin)
        for k, x in zip(kind, payload, strict=True):
            if k == "texts":
                r, log_base, log_score, count, *lows = _unpack(x)
                known[r] += count.astype(np.int64)
                base[r] += log_base
                score[r] += log_score + sum(a * b for a, b in zip(low_logs, lows, strict=True))
            elif k == "backoff":
                r, adds = _unpack(x)
                score[r] += adds
        return pa.Table.from_arrays(
            [pa.array(ids, mask=(flags & 2) > 0), pa.array((flags & 1) == 0), pa.array(n), pa.array(known), pa.array(base - n * norm), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    parts = model.where("kind in ('rows', 'texts')").select("kind", "chunk", "payload")
    for part in handed:
        parts = parts.unionByName(part.select(F.lit("backoff").alias("kind"), "chunk", "payload"))
    out = parts.groupBy("chunk").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", F.lit(vocabulary).cast("long").alias("vocabulary"))
