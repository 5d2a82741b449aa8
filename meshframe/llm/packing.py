"""Best-fit packing by a configuration linear program.

Pieces of at most ``capacity`` tokens are counted by length. A configuration is a
multiset of lengths that fits one sequence. The covering program (least number of
configurations that cover all counts) is solved by multiplicative weights: lengths
have prices, a knapsack by dynamic programming finds the dearest configuration,
which is used and lowers the prices of what it covers. The fractional solution is
rounded down and the rest is packed best-fit by length counts. All of this works
on the histogram, whose size the capacity bounds; pieces then take their places by
their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import END_ID, encoded, tokenizer_path
from .tables import stored

#: Rounds of multiplicative weights end when the solution is within this share of its
#: lower bound, and at the latest after so many.
GAP, ROUNDS = 0.001, 256
#: How strongly a round lowers prices.
RATE = 0.03
#: Pieces that one task ranks at most, about.
PER_SALT = 1_000_000


def pieces(documents: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """documents: doc_id, text (null: empty). A document is the ids of its whole text
    and one end id. Only longer ones than ``capacity`` are cut; the first piece may
    be shorter. A row per piece: doc_id, piece, start, length, ids_crc32 of its ids as
    little-endian unsigned 32 bits. Repeated rows and null ids give pieces each; other
    columns are dropped."""
    path = path or tokenizer_path()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, n in encoded(batches, path):
            ids = ids.astype("<u4")
            out, at = [], 0
            for doc, k in zip(rows.column(0).to_pylist(), n.tolist(), strict=True):
                own = np.append(ids[at : at + k], np.uint32(END_ID)).astype("<u4")
                at += k
                low, piece = 0, 0
                high = (k + 1) % capacity or min(capacity, k + 1)
                while low < k + 1:
                    out.append((doc, piece, low, high - low, zlib.crc32(own[low:high].tobytes())))
                    low, high, piece = high, high + capacity, piece + 1
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = (rows.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(kernel, "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest price that fits each room, lengths repeated at will, and the largest room
    up to it that its best filling fills, with the length laid there last: (room, length)."""
    lengths = np.flatnonzero(prices > 0)
    lengths = lengths[lengths > 0]
    own = prices[lengths]
    value, took = np.zeros(capacity + 1), np.zeros((capacity + 1, 2), dtype=np.int64)
    if not len(lengths):
        return value, took
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        n = fits[room]
        with_one = value[room - lengths[:n]] + own[:n]
        best = int(with_one.argmax())
        if with_one[best] > value[room - 1]:
            value[room], took[room] = with_one[best], (room, lengths[best])
        else:
            value[room], took[room] = value[room - 1], took[room - 1]
    return value, took


def filling(took: np.ndarray, room: int) -> dict[int, int]:
    """How often the best filling of a room has each length."""
    out: dict[int, int] = {}
    while True:
        full, n = took[room]
        if not n:
            return out
        out[n] = out.get(n, 0) + 1
        room = full - n


def dearest(prices: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of the highest price: how often it has each length, within limits."""
    out = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in filling(knapsack(prices, capacity)[1].tolist(), capacity).items():
        out[n] = k
    return np.minimum(out, limits)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing on counts: each time the longest lengths that still fit;
    a configuration is used as often as the counts allow."""
    left, out = counts.copy(), []
    while left.any():
        use, room = np.zeros(capacity + 1, dtype=np.int64), capacity
        while True:
            have = np.flatnonzero(left[: room + 1] - use[: room + 1] > 0)
            if not len(have):
                break
            n = int(have[-1])
            k = min(room // n, int(left[n] - use[n]))
            use[n] += k
            room -= k * n
        times = int((left[use > 0] // use[use > 0]).min())
        left -= use * times
        out.append((use, times))
    return out


def fractional(demand: np.ndarray, capacity: int, rounds: int, rate: float) -> Iterator[tuple[dict[tuple, float], float]]:
    """The covering program by multiplicative weights: after 4, 8, 16, ... rounds, how often
    each configuration (pairs of length and count) is used, as a fraction, covering no
    length more than once over, and a lower bound of the number of sequences.

    A round prices lengths, finds by dynamic programming the dearest filling of a sequence
    around each length, uses those within ``rate`` of the dearest of all while they are
    needed, and lowers the prices of what they cover. Prices over the dearest filling's are
    a feasible dual solution, so each round gives a bound."""
    lengths = np.flatnonzero(demand)
    sizes = np.arange(capacity + 1)
    bound = float((demand * sizes).sum()) / capacity
    prices = np.where(demand > 0, sizes / capacity, 0.0)
    used: dict[tuple, float] = {}
    covered = np.zeros(capacity + 1)
    for done in range(1, rounds + 1):
        value, took = knapsack(prices, capacity)
        took = took.tolist()
        most = value[capacity]
        bound = max(bound, float((demand * prices).sum()) / most)
        around = value[capacity - lengths] + prices[lengths]
        left = demand.astype(float)
        for k in np.argsort(-around, kind="stable").tolist():
            n = int(lengths[k])
            if around[k] < (1 - rate) * most:
                break
            if left[n] <= 0:
                continue
            use = filling(took, capacity - n)
            use[n] = use.get(n, 0) + 1
            amount = min(left[m] / c for m, c in use.items())
            if amount > 0:
                for m, c in use.items():
                    left[m] -= amount * c
                key = tuple(sorted(use.items()))
                used[key] = used.get(key, 0.0) + amount
        share = np.where(demand > 0, 1 - left / np.maximum(demand, 1), 0.0)
        covered += share
        prices = np.where(demand > 0, prices * np.exp(-rate * (share - share[lengths].mean())), 0.0) / most
        if done == rounds or (done >= 4 and not done & (done - 1)):
            scale = 1 / max(covered[lengths].max(), 1e-12)
            yield {k: x * scale for k, x in used.items()}, bound


def rounded(left: np.ndarray, used: dict[tuple, float], capacity: int) -> list[tuple[np.ndarray, int]]:
    """The fractions rounded down, then whole configurations while pieces for them are
    left, those with the least waste first, then best-fit; of several limits of that waste
    the one that gives the fewest sequences."""

    def take(rest: np.ndarray, key: tuple, times: int) -> int:
        for n, k in key:
            times = min(times, int(rest[n]) // k)
        for n, k in key:
            rest[n] -= k * times
        return times

    def row(key: tuple) -> np.ndarray:
        out = np.zeros(capacity + 1, dtype=np.int64)
        for n, k in key:
            out[n] = k
        return out

    left, done = left.copy(), []
    for key, x in sorted(used.items(), key=lambda e: -e[1]):
        if x >= 1 and (times := take(left, key, int(x + 1e-9))):
            done.append((row(key), times))
    waste = {key: capacity - sum(n * k for n, k in key) for key in used}
    order = sorted(used, key=lambda k: (waste[k], -used[k]))
    best = None  # the keys and their times of an option; its rows are made for the best one only
    for most in (-1, 0, 2, 8, capacity):
        rest = left.copy()
        some = [(key, t) for key in order if waste[key] <= most and (t := take(rest, key, 1 << 62))]
        more = best_fit(rest, capacity)
        n = sum(t for _, t in some) + sum(t for _, t in more)
        if best is None or n < best[0]:
            best = (n, some, more)
    return done + [(row(key), t) for key, t in best[1]] + best[2]


def packing_plan(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE, gap: float = GAP) -> tuple[list[tuple[np.ndarray, int]], int]:
    """Configurations (count per length) and how often each is used, that together hold
    exactly ``counts`` pieces of each length (counts[0] must be 0), and a lower bound of
    their number. Rounds double until the plan is within ``gap`` of the bound; if none is,
    what the fractions leave when rounded down is a smaller program, solved alike."""
    full = np.zeros(capacity + 1, dtype=np.int64)
    full[capacity] = 1
    whole = [(full, int(counts[capacity]))] if counts[capacity] else []
    left = counts.copy()
    left[capacity] = 0
    best, bound = None, 0
    if left.any():
        for used, low in fractional(left, capacity, rounds, rate):
            plan = rounded(left, used, capacity)
            if best is None or sum(t for _, t in plan) < sum(t for _, t in best):
                best = plan
            bound = int(np.ceil(low - 1e-6))
            if sum(t for _, t in best) <= max(bound + 1, (1 + gap) * bound):
                break
        else:
            rest, some = left.copy(), []
            for key, x in sorted(used.items(), key=lambda e: -e[1]):
                use = np.zeros(capacity + 1, dtype=np.int64)
                use[[n for n, _ in key]] = [k for _, k in key]
                if (times := min(int(x + 1e-9), int((rest[use > 0] // use[use > 0]).min()))):
                    rest -= use * times
                    some.append((use, times))
            if some and rounds >= 64:
                some += packing_plan(rest, capacity, rounds // 2, rate, gap)[0]
                best = min(best, some, key=lambda o: sum(t for _, t in o))
    return whole + (best or []), bound + int(counts[capacity])


def configurations(counts: np.ndarray, capacity: int, **parameters) -> list[tuple[np.ndarray, int]]:
    return packing_plan(counts, capacity, **parameters)[0]


def places(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length and configuration: (length, first rank, end rank, how often a
    sequence has it, first sequence, offset in the sequence of the first such piece)."""
    rank: dict[int, int] = {}
    out, base = [], 0
    for use, times in plan:
        offset = 0
        for n in np.flatnonzero(use)[::-1].tolist():
            k = int(use[n])
            low = rank.get(n, 0)
            out.append((n, low, low + k * times, k, base, offset))
            rank[n] = low + k * times
            offset += k * n
        base += times
    return out


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """cut: rows with length (1 to capacity) and any other columns; it is read more
    than once and should be a stored table. Adds sequence_id and offset.

    Ranks among pieces of one length come from salted groups and their counts, so
    that a length with a third of all pieces is no single task."""
    spark = cut.sparkSession
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in hist.items():
        counts[n] = k
    table = places(configurations(counts, capacity))
    schema = "length long, low long, high long, per long, base long, at long"
    slots = spark.createDataFrame(table or [], schema)
    salts = max(16, -(-int(counts.sum()) // PER_SALT))
    keys = [c for c in ("doc_id", "piece") if c in cut.columns]
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    run = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("length", "_salt", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy(*keys)
    ranked = salted.withColumn("_k", F.row_number().over(within) - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_k"))
    # a length has few configurations each; the table is bounded by capacity and rounds
    fits = (ranked["length"] == slots["length"]) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high"))
    step = F.col("_rank") - F.col("low")
    return ranked.join(F.broadcast(slots), fits).select(
        *[ranked[c] for c in cut.columns],
        (F.col("base") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + (step % F.col("per")) * ranked["length"]).cast("long").alias("offset"),
    )


def packed(documents: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Encodes once (a stored table) and packs. Empty table: no rows; a null or empty
    text is one piece, the end id. Repeated rows are packed each."""
    return pack(stored(pieces(documents, capacity, path)), capacity)
