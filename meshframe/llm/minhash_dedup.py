"""MinHash near-dedup on SetSketch registers.

A document is the set of its distinct shingles; two link when
100 * |A & B| >= least * |A | B|.

1. Registers. Each shingle is a Poisson process of points, drawn from its hash, that fall
   on registers evenly; a register keeps its least point x, and stores the whole number
   1 - log_b(RATE * x) between 0 and TOP: truncated minima on an exponential scale. The
   registers of a union are the larger ones of both sets (``merged``). Points come in
   ascending order, so a shingle is done once its points are above all minima: about
   n + m ln m points a set of n shingles, not n m.
2. Bands. Registers of two sets are equal with at least the probability of their
   similarity. Sets meet that agree in all ``WIDE`` registers of one of ``BANDS`` bands:
   at similarity 0.85 all bands miss with probability (1 - 0.85^5)^51 < 2e-13.
3. Likelihood. Set sizes are known, so how many registers are larger, smaller and equal
   has a likelihood that depends on the similarity alone. A pair goes no further only if
   similarities from ``least`` on are less likely than the best estimate by a factor of
   e^DOUBT (once in 1e9 for a pair at the threshold).
4. What is left is verified by exact intersection of the full sets, see ``meeting``.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import meeting, ngram_join
from . import words as W

#: Bands, and registers of a band.
BANDS, WIDE = 51, 5
REGISTERS = BANDS * WIDE
#: Base of the exponential scale, rate of the process per register, largest register.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Logarithm of the factor by which a pair is unlikely before it is given up.
DOUBT = 18.0

_SCALE = math.log(BASE)
#: Points that are drawn at a time, about.
_POINTS = 1 << 18


def minima(value: np.ndarray, begin: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The least point on each register, a row a set (infinite for an empty set)."""
    sets = len(begin) - 1
    low = np.full((sets, m), np.inf)
    flat = low.reshape(-1)
    row = np.repeat(np.arange(sets), np.diff(begin))
    h, x, drawn = value, np.zeros(len(value)), 0
    while len(h):
        k = max(1, min(64, _POINTS // len(h)))
        number = np.arange(drawn + 1, drawn + k + 1, dtype=np.uint64) * W._K1
        draw = W.mix(h[:, None] + number)
        gap = np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / -m
        at = x[:, None] + np.cumsum(gap, axis=1)
        place = row[:, None] * m + (W.mix(draw ^ W._K3) % np.uint64(m)).astype(np.int64)
        np.minimum.at(flat, place.reshape(-1), at.reshape(-1))
        x, drawn = at[:, -1], drawn + k
        more = x < low.max(axis=1)[row]
        h, x, row = h[more], x[more], row[more]
    return low


def registers(value: np.ndarray, begin: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers of each set, a row a set; all 0 for an empty one."""
    x = minima(value, begin, m)
    with np.errstate(divide="ignore"):
        scaled = np.floor(1 + math.log(RATE) / _SCALE - np.log(x) / _SCALE)
    return np.clip(scaled, 0, TOP).astype(np.uint16)


def merged(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(one, two)


def sketches(value: np.ndarray, begin: np.ndarray) -> pa.Array:
    rows = registers(value, begin)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (2 * REGISTERS)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def _table(marks: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(marks), dtype=np.uint16).reshape(len(marks), REGISTERS)


def keys_of(marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys on which sets meet: the registers of each band."""
    bands = _table(marks).reshape(len(marks), BANDS, WIDE).astype(np.uint64)
    key = W.mix(np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * W._K2, (len(marks), BANDS)))
    for k in range(WIDE):
        key = W.combine(key, bands[:, :, k])
    return np.repeat(np.arange(len(marks)), BANDS), key.reshape(-1)


def _larger(x: np.ndarray) -> np.ndarray:
    """Probability that a register is larger for a share x of elements of its own."""
    return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / _SCALE


def log_likelihood(similarity: np.ndarray, n: np.ndarray, m: np.ndarray, more: np.ndarray, less: np.ndarray, of: int = REGISTERS) -> np.ndarray:
    """For sets of n and m elements of which ``more`` registers are larger and ``less``
    smaller on the first one."""
    u = n / (n + m)
    a, b = _larger(u - (1 - u) * similarity), _larger(1 - u - u * similarity)
    tiny = 1e-12
    return more * np.log(np.maximum(a, tiny)) + less * np.log(np.maximum(b, tiny)) + (of - more - less) * np.log(np.maximum(1 - a - b, tiny))


def estimate(n: np.ndarray, m: np.ndarray, more: np.ndarray, less: np.ndarray, of: int = REGISTERS) -> np.ndarray:
    """The most likely similarity. On so fine a scale ``_larger(x)`` is x, so the share of
    equal registers is the similarity, and the likelihood's slope is zero at a root of a
    quadratic."""
    u, v = n / (n + m), m / (n + m)
    equal = of - more - less
    p, q = u * v * of, (equal * (u * u + v * v) + more * v * v + less * u * u) / 2
    root = (q - np.sqrt(np.maximum(q * q - p * equal * u * v, 0))) / p
    return np.clip(root, 0, np.minimum(u / v, v / u))


def may_be_linked(n: np.ndarray, m: np.ndarray, more: np.ndarray, less: np.ndarray, least: int) -> np.ndarray:
    """False where sizes or the likelihood rule out a similarity of ``least`` hundredths."""
    out = 100 * np.minimum(n, m) >= least * np.maximum(n, m)
    todo = np.flatnonzero(out & (100 * (REGISTERS - more - less) < least * REGISTERS))
    if len(todo):
        x = [v[todo].astype(np.float64) for v in (n, m, more, less)]
        best = estimate(*x)
        far = log_likelihood(best, *x) - log_likelihood(np.full(len(todo), least / 100), *x)
        out[todo[(100 * best < least) & (far > DOUBT)]] = False
    return out


def may_link(n: list[int], marks: list[bytes], m: list[int], others: list[bytes], least: int) -> list[bool]:
    if not n:
        return []
    one, two = _table(marks), _table(others)
    return may_be_linked(np.array(n), np.array(m), (one > two).sum(axis=1), (one < two).sum(axis=1), least).tolist()


def near(ids: list[int], group: list[int], n: list[int], marks: list[bytes], least: int) -> list[tuple[int, int]]:
    """Pairs of one tile that may be linked, as many as connect them; sets of one group
    are connected."""
    rows, sizes = _table(marks), np.array(n)
    label = np.unique(np.array(group), return_inverse=True)[1]
    out, todo = [], np.ones(len(ids), dtype=bool)
    for p in np.argsort(-np.bincount(label)[label], kind="stable"):
        todo[p] = False
        far = np.flatnonzero(todo & (label != label[p]))
        if not len(far):
            continue
        more, less = (rows[p] > rows[far]).sum(axis=1), (rows[p] < rows[far]).sum(axis=1)
        for q in far[may_be_linked(np.full(len(far), sizes[p]), sizes[far], more, less, least)].tolist():
            if label[q] != label[p]:
                label[label == label[q]] = label[p]
                if ids[p] != ids[q]:
                    out.append((ids[p], ids[q]))
    return out


def joined(documents: DataFrame, size: int = 3, least: int = 85, tile: int = meeting.TILE, lower: bool = True) -> DataFrame:
    """A row per doc_id: doc_id, n_shingles, component_id, kept (it is the least of its
    component); rows count as ``meeting.joined`` says."""
    method = meeting.Method(size, least, lower, tile, sketches, keys_of, functools.partial(may_link, least=least), functools.partial(near, least=least), ngram_join.links, keys_of_marks=True)
    return meeting.joined(documents, method).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_of_each(documents: DataFrame, **parameters) -> DataFrame:
    """The documents that ``joined`` keeps, all columns kept; see ``meeting.least_of_each``."""
    return meeting.least_of_each(documents, joined(documents, **parameters).drop("kept"))
