"""Toxicity: cumulative-link ordinal regression on sparse text features.

Severity is graded 0 to ``GRADES - 1``. P(grade <= j) = sigmoid(theta_j - w.x): the
ordered thresholds theta share the weights w of the words that a text contains.
The expected severity is the sum of P(grade > j).

The model is fitted on at most ``sample`` labelled documents; every whole text is
scored. The labels say only whether a text is toxic, so toxic training texts are graded
by how many occurrences of telling words they hold (thirds of those counts). These words
are cross-fitted: two halves of the texts each take the words that the other half tells,
so no text is graded by words that its own label has chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import stored

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 20_000
#: Words that can have a weight, at most: those most associated with the labels.
VOCABULARY = 512
#: Least association (signed root of a likelihood ratio) of a word with a weight, and the
#: fewest training texts that hold it.
SURE, SEEN = 4.5, 3
GRADES = 4
#: How strongly weights are held down.
RIDGE = 1e-4

#: Bytes of words: digits, lower-case letters (after lowering) and all outside ASCII.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Model:
    """Hashes of the words with a weight (sorted), their weights, and thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity, and the probability of any severity, for scores w.x."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - x[:, None], -50, 50)))
        return above.sum(axis=1), above[:, 0]


def word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, word hashes and occurrences, a triple for each distinct word of a row."""
    chunk = W.Chunk(texts, WORD_BYTES, lower=True)
    h = chunk.hashes()
    order = np.lexsort((h, chunk.doc))
    row, h = chunk.doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def association(in_bad: Column, in_all: Column, n_bad: int, n_good: int) -> Column:
    """Signed root of the likelihood ratio of a word and the toxic class; 0 without texts."""
    if not n_bad + n_good:
        return F.lit(0.0)
    share = in_all / (n_bad + n_good)
    total = F.lit(0.0)
    for seen, of in ((in_bad, n_bad), (in_all - in_bad, n_good)):
        for cell, mean in ((seen, of * share), (of - seen, of * (1 - share))):
            total = total + F.when(cell > 0, cell * F.log(cell / mean)).otherwise(0.0)
    return F.signum(in_bad - n_bad * share) * F.sqrt(F.greatest(2 * total, F.lit(0.0)))


def grades(row: np.ndarray, col: np.ndarray, times: np.ndarray, toxic: np.ndarray, z: np.ndarray, half: np.ndarray) -> np.ndarray:
    """0 for texts that are not toxic, else the third (1 to 3) that a text's occurrences of
    words that tell in the other half fall into; ties go to the lower one."""
    telling = z[1 - half[row], col] > 0
    amount = np.bincount(row[telling], weights=times[telling], minlength=len(toxic))
    cuts = np.quantile(amount[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + (amount > cuts[0]).astype(int) + (amount > cuts[1]).astype(int), 0)


def fit_arrays(row: np.ndarray, col: np.ndarray, times: np.ndarray, toxic: np.ndarray, keys: np.ndarray, z: np.ndarray, half: np.ndarray, rounds: int = 400) -> Model:
    """row, col, times: how often training text ``row`` has word ``col``; keys: the words'
    hashes (sorted); z: their associations in either half; toxic, half: the texts' labels
    and halves. The loss is the mean negative log-likelihood of the grades, plus half of
    ``RIDGE`` times the squared weights."""
    grade = grades(row, col, times, toxic, z, half)
    x = np.zeros((len(toxic), len(keys)))
    x[row, col] = 1.0
    # thresholds rise by exponents of free steps, so they stay ordered
    w, first, steps = np.zeros(len(keys)), 2.0, np.zeros(GRADES - 2)
    moment = [np.zeros_like(w), 0.0, np.zeros_like(steps)]
    spread = [np.zeros_like(w), 0.0, np.zeros_like(steps)]
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -50, 50)))
    n = len(toxic)
    for t in range(1, rounds + 1):
        theta = first + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
        s = x @ w
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = sigmoid(edge[grade + 1] - s), sigmoid(edge[grade] - s)
        mass = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        g_s = (d_hi - d_lo) / n  # of the loss by the score
        g_theta = np.zeros(GRADES - 1)
        np.add.at(g_theta, grade[grade < GRADES - 1], -d_hi[grade < GRADES - 1] / n)
        np.add.at(g_theta, grade[grade > 0] - 1, d_lo[grade > 0] / n)
        grads = [x.T @ g_s + RIDGE * w, g_theta.sum(), np.array([g_theta[k + 1 :].sum() * np.exp(steps[k]) for k in range(GRADES - 2)])]
        values = [w, first, steps]
        for k, g in enumerate(grads):
            moment[k] = 0.9 * moment[k] + 0.1 * g
            spread[k] = 0.99 * spread[k] + 0.01 * g * g
            values[k] = values[k] - 0.1 * (moment[k] / (1 - 0.9**t)) / (np.sqrt(spread[k] / (1 - 0.99**t)) + 1e-9)
        w, first, steps = values
    theta = first + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
    return Model(keys, w, theta)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY, sure: float = SURE, least_seen: int = SEEN) -> Model | None:
    """documents: doc_id, text; labels: doc_id, toxic (0/1). The labelled ids with the
    least hashes, ``sample`` at most, are joined to their texts. Words are counted and
    chosen on the cluster; the chosen ones' places in these texts come to the driver.

    Rows with a null id or label are left out; of several labels or texts of an id the
    greatest counts; a null text has no words; other columns are ignored. Without toxic or
    without other texts, or without a word that tells them apart, there is no model."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, part in W.chunks(batch):
                row, key, times = word_counts(part)
                cuts = pa.array(np.searchsorted(row, np.arange(high - low + 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(cuts, pa.array(key.view(np.int64)))
                counts = pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), lists, counts], names=["doc_id", "toxic", "keys", "times"])

    got = texts.mapInArrow(kernel, "doc_id long, toxic int, keys array<long>, times array<int>")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    got = stored(got.groupBy("doc_id").agg(F.max(F.struct("keys", "times", "toxic")).alias("r")).select("doc_id", "r.*", half.alias("half")))  # one row per id
    n = [tuple(x or 0 for x in r) for r in [got.agg(*[f(c) for h in (0, 1) for f, c in ((F.sum, F.when(F.col("half") == h, 1).otherwise(0)), (F.sum, F.when(F.col("half") == h, F.col("toxic")).otherwise(0)))]).first()]][0]
    n_all, n_bad = n[0] + n[2], n[1] + n[3]
    if not n_bad or n_bad == n_all:
        return None
    in_half = [F.when(F.col("half") == h, c) for h in (0, 1) for c in (F.lit(1), F.col("toxic"))]
    words = got.select("toxic", "half", F.explode("keys").alias("key")).groupBy("key")
    seen = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for c, k in zip(in_half, ("a0", "b0", "a1", "b1"), strict=True)]).where(F.col("a0") + F.col("a1") >= least_seen)
    parts = [association(F.col(f"b{h}"), F.col(f"a{h}"), n[2 * h + 1], n[2 * h] - n[2 * h + 1]) for h in (0, 1)]
    whole = association(F.col("b0") + F.col("b1"), F.col("a0") + F.col("a1"), n_bad, n_all - n_bad)
    told = seen.select("key", whole.alias("z"), *[p.alias(f"z{h}") for h, p in enumerate(parts)]).where(F.abs("z") > sure)
    told = told.orderBy(F.desc(F.abs("z")), "key").limit(vocabulary).collect()
    if not told:
        return None
    table = sorted((r["key"] % 2**64, r["z0"], r["z1"]) for r in told)
    keys, z = np.array([r[0] for r in table], dtype=np.uint64), np.array([r[1:] for r in table]).T

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's words with a weight: their numbers and occurrences."""
        for batch in batches:
            lists = batch.column("keys")
            cuts = lists.offsets.to_numpy().astype(np.int64)
            own = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[cuts[0] : cuts[-1]]
            times = batch.column("times").values.slice(int(batch.column("times").offsets[0].as_py()), len(own))
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == own)
            ends = pa.array(np.searchsorted(hit, cuts - cuts[0]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), batch.column("half"), pa.ListArray.from_arrays(ends, pa.array(at[hit].astype(np.int32))), pa.ListArray.from_arrays(ends, times.take(pa.array(hit)))],
                names=["doc_id", "toxic", "half", "cols", "times"],
            )

    rows = got.select("doc_id", "toxic", "half", "keys", "times").mapInArrow(places, "doc_id long, toxic int, half int, cols array<int>, times array<int>").toArrow()  # ``sample`` rows at most
    rows = rows.sort_by("doc_id").combine_chunks()
    n_words = pa.compute.list_value_length(rows["cols"]).to_numpy()
    flat = lambda c: pa.compute.list_flatten(rows[c]).to_numpy()
    return fit_arrays(np.repeat(np.arange(len(rows)), n_words), flat("cols"), flat("times"), rows["toxic"].to_numpy() > 0, keys, z, rows["half"].to_numpy())


def scored(documents: DataFrame, model: Model | None) -> DataFrame:
    """A row per document: doc_id, expected_severity, severity (the nearest grade),
    p_toxic and toxic (p_toxic of a half or more). Null or empty texts and texts
    without known words get the model's base rate; without a model all are 0. Repeated
    rows and null ids stay as they are; other columns are dropped."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, part in W.chunks(batch):
                n = high - low
                expected = p = np.zeros(n)
                if model is not None:
                    chunk = W.Chunk(part, WORD_BYTES, lower=True)
                    h = chunk.hashes()
                    at = np.minimum(np.searchsorted(model.keys, h), len(model.keys) - 1)
                    hit = np.flatnonzero(model.keys[at] == h)
                    pair = np.unique(chunk.doc[hit] * len(model.keys) + at[hit])
                    x = np.bincount(pair // len(model.keys), weights=model.weights[pair % len(model.keys)], minlength=n)
                    expected, p = model.severity(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), pa.array(expected, pa.float64()), pa.array(p, pa.float64())], names=["doc_id", "e", "p"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kernel, "doc_id long, e double, p double")
    return rows.select("doc_id", F.col("e").alias("expected_severity"), F.rint("e").cast("int").alias("severity"), F.col("p").alias("p_toxic"), (F.col("p") >= 0.5).alias("toxic"))
