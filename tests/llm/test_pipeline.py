"""The stages one after the other, each against a plain version of its decisions."""

import collections
import re

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
SPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def features(t):
    """The numbers that rules look at, by plain counting; None if the base checks fail."""
    w = SPACE.findall(t)
    at = collections.defaultdict(list)
    for k in range(len(w) - 2):
        at[tuple(w[k : k + 3])].append(k)
    again = len({p + j for v in at.values() if len(v) > 1 for p in v for j in range(3)})
    if len(w) < 50 or 100 * again > 50 * len(w):
        return None
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    n, chars = len(w), sum(map(len, w))
    count = lambda s: sum(t.count(c) for c in s)
    return [n, chars / n, count("#*$%&|<>") / n, len(lines) - len(set(lines)), again / n, count("!?") / n, sum("A" <= c <= "Z" for c in t) / chars, n / len(lines), len(set(w)) / n]


def passes(t, rules):
    x = features(t or "")
    return x is not None and not any(all(x[f] >= v if least else x[f] <= v for f, least, v in r.conditions) for r in rules)


def near_groups(texts, size, least):
    """The least id of each text's component."""
    sets = {}
    for i, t in texts.items():
        w = SPACE.findall(low(t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def kept_words(texts, length):
    first, out = {}, {}
    for i in sorted(texts):
        w = SPACE.findall(texts[i] or "")
        gone = set()
        for k in range(len(w) - length + 1):
            if first.setdefault(tuple(w[k : k + length]), i) < i:
                gone |= set(range(k, k + length))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def windows_of(items):
    out = set()
    for t in items:
        w = ALNUM.findall(low(t or ""))
        out |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    return out


def leaks(t, windows):
    w = ALNUM.findall(low(t or ""))
    return any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))


def test_stages(spark):
    from pyspark.sql import functions as F

    from meshframe.llm import encode, quality_rules
    from meshframe.llm.tables import documents, stored

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)
    docs = documents(spark, SF)
    names = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    def step(name, docs):
        out = stored(stages[name](spark, docs, SF))
        assert out.columns == names
        rows = out.collect()
        assert len({r["doc_id"] for r in rows}) == len(rows)
        return out, {r["doc_id"]: r["text"] for r in rows}

    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", (F.col("quality") == 0).cast("int").alias("bad"))
    rules = quality_rules.fit(docs, labels)
    docs, got = step("quality_rules", docs)
    want = {i: t for i, t in texts.items() if passes(t, rules)}
    assert got == want and 0 < len(got) < len(texts)

    roots = near_groups(got, 5, 80)
    want = {i: t for i, t in got.items() if roots[i] == i}
    docs, got = step("ngram_jaccard_join", docs)
    assert got == want

    words = kept_words(got, 50)
    before = got
    docs, got = step("substring_dedup", docs)
    assert {i: SPACE.findall(t or "") for i, t in got.items()} == {i: w for i, w in words.items() if w or before[i] is None}
    assert all(got[i] == before[i] for i in got if len(words[i]) == len(SPACE.findall(before[i] or "")))

    windows = windows_of(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    want = {i: t for i, t in got.items() if not leaks(t, windows)}
    docs, got = step("benchmark_decontamination", docs)
    assert got == want

    out = stages["best_fit_packing"](spark, docs, SF).collect()
    import pyarrow as pa

    ids = sorted(got)
    _, n = encode.encode_chunk(pa.array([got[i] for i in ids], pa.large_string()), encode.tokenizer_path())
    held, room = collections.Counter(), collections.Counter()
    for r in out:
        held[r["doc_id"]] += r["length"]
        room[r["sequence_id"]] += r["length"]
    assert held == {i: int(k) + 1 for i, k in zip(ids, n, strict=True)}
    assert max(room.values()) <= 2048 and len(room) <= -(-int(np.sum(n + 1)) // 2048) + 1


def oddities():
    """Nulls in any column, empty and long texts, repeated rows, columns that stages use themselves."""
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    body = " ".join(f"w{k}" for k in range(60))
    long = " ".join(f"x{k * k % 7919}y{k}" for k in range(30_000))
    rows = [(1, body), (1, body), (2, body), (None, body), (3, None), (4, ""), (5, long), (6, " \n"), (None, None), (7, " ".join(f"v{k}" for k in range(70)) + " " + leak), (8, leak + " " + long[:900])]
    return [(i, t, None if i == 2 else "en", None, k if k % 2 else None, k, f"_{k}", None) for k, (i, t) in enumerate(rows)]


_ODD = "doc_id long, text string, lang string, source string, n_chars long, key long, _w string, cuts int"


def test_odd_rows(spark):
    docs = spark.createDataFrame(oddities(), _ODD)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count(), name
    kept = lambda name: sorted(str(r["doc_id"]) for r in stages[name](spark, docs, SF).collect())
    from pyspark.sql import functions as F

    from meshframe.llm import quality_rules

    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", (F.col("quality") == 0).cast("int").alias("bad"))
    rules = quality_rules.fit(docs, labels)
    assert kept("quality_rules") == sorted(str(r[0]) for r in oddities() if passes(r[1], rules))
    assert kept("ngram_jaccard_join") == ["1", "3", "4", "5", "6", "7", "8", "None", "None"]
    assert kept("substring_dedup") == ["1", "1", "3", "5", "7", "8", "None", "None"]
    assert kept("benchmark_decontamination") == sorted(str(r[0]) for r in oddities())
    out = stages["best_fit_packing"](spark, docs, SF).collect()
    assert collections.Counter(str(r["doc_id"]) for r in out if r["piece"] == 0) == collections.Counter(str(r[0]) for r in oddities())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], _ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_gives_the_last_stage(spark):
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, SF).columns)
