"""Quality rules: decision lists learnt by sequential covering.

Statistics of each text are DataFrame expressions. From labelled documents a list
of rules is learnt, one after the other: a conjunction of thresholds is grown by
information gain on the growing part of the labelled rows, pruned from its end on
the pruning part, kept while it is precise there, and its rows are taken away. The
list becomes one ordered conditional Spark expression.

Fitting uses at most ``sample`` labelled documents (those with the least hashes of
their ids); the statistics and the verdict cover every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import quoted

#: Labelled documents that a list is learnt from, at most.
SAMPLE = 20_000
#: White space between words.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "chars_per_word", "symbols_per_word", "dup_lines", "repeat_share", "marks_per_word", "capitals_per_char", "words_per_line", "distinct_share")


def statistics(documents: DataFrame, *keep: str) -> DataFrame:
    """documents: text and the columns to keep. Adds n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words and four more counts. Null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = documents.select(*keep, text.alias("_t"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = base.select(*keep, "_t", F.array_remove(F.split("_t", SPACE), "").alias("_w"), lines.alias("_l"))
    # every 3-word window as (hash, place), sorted, so that equal windows are neighbours
    w = F.col("_w")
    grams = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    cut = cut.select(*keep, "_t", "_w", "_l", F.sort_array(F.slice(grams, 1, F.greatest(F.size("_w") - 2, F.lit(0)))).alias("_g"))
    g = F.col("_g")
    again = F.transform(g, lambda x, k: F.when((x["h"] == F.get(g, k - 1)["h"]) | (x["h"] == F.get(g, k + 1)["h"]), x["i"]))
    cut = cut.select(*keep, "_t", "_w", "_l", F.sort_array(F.filter(again, lambda x: x.isNotNull())).alias("_p"))
    p = F.col("_p")
    reach = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    counts = (
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        (F.length("_t") - F.length(F.translate("_t", "!?", ""))).cast("long").alias("n_marks"),
        (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
    )
    # one row of a generator: filters on counts stay above it, else they would be computed in every lambda
    return cut.select(*keep, F.inline(F.array(F.struct(*counts))))


def features() -> dict[str, Column]:
    """What thresholds are set on, from the counts."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return dict(zip(FEATURES, (
        F.col("n_words").cast("double"), F.col("word_chars") / n, F.col("n_symbols") / n, F.col("n_dup_lines").cast("double"), F.col("n_repeat_words") / n,
        F.col("n_marks") / n, F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)), F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_distinct") / n,
    ), strict=True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is it a least value, threshold); rejects what it covers."""

    conditions: tuple[tuple[int, bool, float], ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, least, t in self.conditions:
            out &= x[:, f] >= t if least else x[:, f] <= t
        return out

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, least, t in self.conditions:
            c = values[FEATURES[f]]
            out = out & ((c >= t) if least else (c <= t))
        return out


def _grow(x: np.ndarray, bad: np.ndarray, conditions: int, cuts: int) -> Rule:
    """Adds the threshold of the highest information gain until no good row is covered."""
    have: list[tuple[int, bool, float]] = []
    inside = np.ones(len(x), dtype=bool)
    while len(have) < conditions and bad[inside].any() and not bad[inside].all():
        p0 = bad[inside].mean()
        best = (0.0, None)
        for f in range(x.shape[1]):
            v = x[inside, f]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, cuts), method="lower")):
                for least in (True, False):
                    take = v >= t if least else v <= t
                    p, n = int(bad[inside][take].sum()), int(take.sum())
                    if p and n < len(v) and (gain := p * (np.log2(p / n) - np.log2(p0))) > best[0] + 1e-9:
                        best = (gain, (f, least, float(t)))
        if best[1] is None:
            break
        have.append(best[1])
        inside = Rule(tuple(have)).covers(x)
    return Rule(tuple(have))


def learn(x: np.ndarray, bad: np.ndarray, grow: np.ndarray, rules: int = 12, conditions: int = 4, cuts: int = 48, precision: float = 0.95, least: int = 5) -> list[Rule]:
    """x: a row of features each; bad: what to reject; grow: rows to grow on, the others
    prune. A rule stays while at least ``precision`` of the rows that it covers in the
    pruning part (and as many in the growing part) are bad, ``least`` rows at least."""
    out: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    while len(out) < rules:
        g, p = left & grow, left & ~grow
        if bad[g].sum() < least:
            break
        rule = _grow(x[g], bad[g], conditions, cuts)
        options = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]

        def worth(r: Rule, p: np.ndarray = p) -> float:
            c = r.covers(x[p])
            return (2 * bad[p][c].sum() - c.sum()) / c.sum() if c.any() else -1.0

        if not options:
            break
        rule = max(options, key=lambda r: (worth(r), -len(r.conditions)))
        sure = [part[rule.covers(x[rows])] for rows in (g, p) for part in (bad[rows],)]
        if any(len(s) < least or s.mean() < precision for s in sure):
            break
        out.append(rule)
        left &= ~rule.covers(x)
    return out


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, **parameters) -> list[Rule]:
    """documents: doc_id, text; labels: doc_id, bad (0/1). Only ``sample`` labelled ids
    go to the executors, and as many rows of nine numbers come back."""
    known = labels.where("doc_id is not null and bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    some = known.select("doc_id", "bad", F.xxhash64("doc_id").alias("_o")).orderBy("_o", "doc_id").limit(sample)
    rows = statistics(documents.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "doc_id", "bad", "_o")
    # of several texts of an id, the one with the least counts
    rows = rows.where(~base_failed()).groupBy("doc_id").agg(F.min(F.struct(*[c for c in rows.columns if c != "doc_id"])).alias("_s")).select("doc_id", "_s.*")
    got = rows.select("doc_id", "bad", "_o", *[c.alias(k) for k, c in features().items()]).orderBy("doc_id").collect()
    if not got:
        return []
    x = np.array([[r[k] for k in FEATURES] for r in got], dtype=float)
    bad = np.array([r["bad"] for r in got]) > 0
    return learn(x, bad, np.array([r["_o"] % 3 != 0 for r in got]), **parameters)


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the number of the first rule that covers
    a row, or null."""
    values = features()
    out = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        out = F.when(rules[k].column(values), F.lit(k + 1)).otherwise(out)
    return out


def judged(documents: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """A row per document: doc_id, the counts, base_failed, kept, rule (the number of the
    rule that rejects it, or null). Without labels no rule is learnt. Repeated rows stay."""
    rules = fit(documents, labels, **parameters)
    rows = statistics(documents, "doc_id").withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return rows.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def kept(documents: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The documents that neither the base checks nor a rule rejects, all columns kept."""
    rules = fit(documents, labels, **parameters)
    own = documents.columns
    packed = documents.select(F.struct(*[F.col(quoted(c)) for c in own]).alias("_row"), F.col("text"))
    rows = statistics(packed, "_row").where(~base_failed() & verdict(rules).isNull())
    return rows.select(*[F.col(f"_row.{quoted(c)}").alias(c) for c in own])
