"""Every operator against a brute-force version, on small tables with nulls in any
column, empty and long texts, ties, repeated rows and columns with clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("meshframe.llm")

from meshframe.llm import components, decontaminate, encode, katz, license_scan, ngram_join, packing, quality_rules, substring_dedup, token_counts, toxicity, url_filter
from meshframe.llm import words as W

SPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def corpus(seed=7, n=60):
    """Invented texts with copies, near copies, shared passages, repeats and oddities."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    say = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, base = say(60), say(120)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            w = say(rng.randrange(1, 90))
        elif kind == 1:
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind == 2:
            w = say(30) + passage + say(20)
        elif kind == 3:
            w = rows[rng.randrange(len(rows))][1].split()
        elif kind == 4:
            w = say(3) * 20
        else:
            w = [x.upper() + rng.choice(["", ".", "!!", " |"]) for x in say(70)]
        rows.append((i, rng.choice([" ", "\n", "  ", " \t"]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one"), (n + 4, "a b c"), (n + 5, "A B c"), (n + 6, " ".join(say(9000))), (n + 7, "x\x00y\x85z　q\xa0r   s")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """doc_id and text among columns whose names operators use themselves."""
    rows = [(i, t, "en", None, i) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, n int, key long").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_word_kernel():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \n\té日\x1c") for _ in range(rng.randrange(0, 40))) for _ in range(500)] + [None, "", "x" * 5000]
    chunk = W.Chunk(pa.array(texts, pa.large_string()), lower=True)
    words = [chunk.word(k).decode() for k in range(len(chunk))]
    want = [SPACE.findall(t or "") for t in texts]
    assert words == [w for x in want for w in x]
    assert np.diff(chunk.first).tolist() == [len(x) for x in want]
    h = {}
    for w, k in zip(words, chunk.hashes().tolist(), strict=True):
        assert h.setdefault(low(w), k) == k
    assert len(set(h.values())) == len(h)


def test_katz(spark, docs):
    got = by_id(katz.scores(docs))
    toks = {i: SPACE.findall(low(t or "")) + [None] for i, t in corpus()}
    train = {i: zlib.crc32(str(i).encode()) % 10 != 0 for i in toks}
    c1 = collections.Counter(w for i, x in toks.items() if train[i] for w in x)
    c2 = collections.Counter(p for i, x in toks.items() if train[i] for p in zip([0, *x[:-1]], x, strict=True))
    n, v = sum(c1.values()), len(c1)
    nr = lambda c: [sum(1 for k in c.values() if k == r) for r in range(1, katz.K + 2)]
    d1, d2 = katz.discounts(nr(c1)), katz.discounts(nr(c2))
    kept = lambda c, d: float(katz.kept(np.array([c]), d)[0])
    unknown = 1 - sum(kept(c, d1) for c in c1.values()) / n
    p1 = lambda w: kept(c1[w], d1) / n if w in c1 else unknown
    total, used, mass = collections.Counter(), collections.Counter(), collections.Counter()
    for (a, b), c in c2.items():
        total[a] += c
        used[a] += kept(c, d2)
        mass[a] += p1(b)
    alpha = lambda a: (total[a] - used[a]) / total[a] / (1 - mass[a]) if a in total else 1.0
    p2 = lambda a, b: kept(c2[a, b], d2) / total[a] if (a, b) in c2 else alpha(a) * p1(b)
    assert sum(p1(w) for w in c1) + unknown == pytest.approx(1)
    for a in list(total)[:20]:  # exactly normalised
        assert sum(p2(a, w) for w in c1) + alpha(a) * unknown == pytest.approx(1)
    for i, x in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train[i], len(x), sum(w in c1 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x))
        assert r["score"] == pytest.approx(sum(math.log10(p2(a, b)) for a, b in zip([0, *x[:-1]], x, strict=True)))


@pytest.mark.parametrize("order, bucket", [(3, None), (4, 900)])
def test_katz_recurses_over_orders(spark, docs, order, bucket):
    got = by_id(katz.scores(docs, order=order, per_bucket=bucket))
    toks = {i: SPACE.findall(low(t or "")) + [None] for i, t in corpus()}
    train = {i: zlib.crc32(str(i).encode()) % 10 != 0 for i in toks}
    grams = lambda x, k: [((0, *x)[p + 2 - k : p + 1], w) for p, w in enumerate(x) if p + 2 >= k]
    c = {1: collections.Counter(((), w) for i, x in toks.items() if train[i] for w in x)}
    c |= {k: collections.Counter(g for i, x in toks.items() if train[i] for g in grams(x, k)) for k in range(2, order + 1)}
    d = {k: katz.discounts([sum(1 for v in c[k].values() if v == r) for r in range(1, katz.K + 2)]) for k in c}
    kept = lambda n, k: float(katz.kept(np.array([n]), d[k])[0])
    n = sum(c[1].values())
    unknown = 1 - sum(kept(x, 1) for x in c[1].values()) / n
    after = collections.defaultdict(dict)
    for k in range(2, order + 1):
        for (h, w), x in c[k].items():
            after[h][w] = x
    alphas = {}

    def p(h, w):
        if not h:
            return kept(c[1][h, w], 1) / n if (h, w) in c[1] else unknown
        words = after.get(h, {})
        if w in words:
            return kept(words[w], len(h) + 1) / sum(words.values())
        if words and h not in alphas:
            alphas[h] = (1 - sum(p(h, x) for x in words)) / (1 - sum(p(h[1:], x) for x in words))
        return alphas.get(h, 1.0) * p(h[1:], w)

    for h in [h for h in after if len(h) == order - 1][:20]:  # exactly normalised
        assert sum(p(h, w) for _, w in c[1]) + p(h, "never met") == pytest.approx(1)
    passed = collections.Counter()
    for i, x in toks.items():
        want = 0.0
        for at, w in enumerate(x):
            h = (0, *x)[max(0, at + 2 - order) : at + 1]
            want += math.log10(p(h, w))
            passed[len(h) - next((k for k in range(len(h)) if w in after.get(h[k:], {})), len(h))] += 1
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (not train[i], len(x), sum(((), w) in c[1] for w in x), n)
        assert got[i]["score"] == pytest.approx(want)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[1][(), w] + 0.1) / (n + 0.1 * (len(c[1]) + 1))) for w in x))
    assert all(passed[k] for k in range(order))  # tokens end at every order


def test_good_turing():
    n = [1000, 400, 210, 130, 90, 66]  # by hand: (r* / r - mu) / (1 - mu), mu = 6 n6 / n1
    mu = 6 * 66 / 1000
    stars = {1: 2 * 400 / 1000, 2: 3 * 210 / 400, 3: 4 * 130 / 210, 4: 5 * 90 / 130, 5: 6 * 66 / 90}
    d = katz.discounts(n)
    assert d[1:].tolist() == pytest.approx([(stars[r] / r - mu) / (1 - mu) for r in range(1, 6)])
    # what the discounts take from counts up to K is what Turing gives to words never met
    assert sum(r * k * (1 - x) for r, k, x in zip(range(1, 6), n, d[1:], strict=False)) == pytest.approx(n[0])
    assert katz.kept(np.array([1, 5, 6, 100]), d).tolist() == pytest.approx([d[1], 5 * d[5], 6 - katz.DELTA, 100 - katz.DELTA])
    uneven = katz.discounts([100, 300, 10, 200, 5, 4])
    assert ((uneven[1:] > 0) & (uneven[1:] < 1)).all() and (np.diff(uneven[1:]) > 0).all()
    assert katz.discounts([0] * 6)[1:].tolist() == pytest.approx([0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9])


def test_katz_stores_backed_off_tokens_packed(spark, docs, monkeypatch):
    """Not a row each: sorted, joined and shuffled rows took an executor's memory."""
    rows, stored = [], katz.stored

    def counted(df, *by):
        out = stored(df, *by)
        rows.extend([out.where("kind = 'backoff'").count()] if by else [])
        return out

    monkeypatch.setattr(katz, "stored", counted)
    held = sum(r["n_tokens"] for r in katz.scores(docs, order=3).collect() if r["held_out"])
    assert 0 < sum(rows) < held / 20


def test_katz_ranks_as_lexsort():
    rng = np.random.default_rng(5)
    for top in (2**64 - 1, 40):  # 40: hashes that differ in low bits only
        values = rng.integers(0, top, 60, dtype=np.uint64)
        word, *before = (values[rng.integers(0, 60, 5000)] for _ in range(3))
        before = [b >> np.uint64(16) if top > 40 else b for b in before]
        assert (katz.ranked(word, before) == np.lexsort((*before[::-1], word))).all()
    assert [len(katz.ranked(x, [x, x])) for x in (word[:0], word[:1])] == [0, 1]


def test_katz_edges(spark, empty):
    assert katz.scores(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in katz.scores(rows).collect()) == [1, 1, 3]
    from pyspark.sql import functions as F

    assert all(r["score"] == 0 and r["n_known"] == 0 for r in katz.scores(rows, F.lit(False)).collect())


def test_ngram_join(spark, docs):
    got = by_id(ngram_join.joined(docs, tile=8))
    sets = {}
    for i, t in corpus():
        w = SPACE.findall(low(t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert len({find(i) for i in sets}) < len(sets) - 5
    # every link, not only those that connect
    links = {a: sum(1 for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])) for a in sets}
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.link_counts(docs, tile=8).collect()} == links


def test_linked_sets_share_a_key():
    rng = random.Random(4)
    linked = 0
    for _ in range(1500):
        n = rng.choice([1, 2, 3, 6, 11, 20, 41, 90, 300])
        a = [rng.getrandbits(64) for _ in range(n)]
        b = a[: n - rng.randrange(0, n // 8 + 1)] + [rng.getrandbits(64) for _ in range(rng.randrange(0, n // 8 + 1))]
        a, b = set(a), set(b)
        if 100 * len(a & b) >= 85 * len(a | b):
            linked += 1
            v = np.concatenate([np.sort(np.array(list(x), dtype=np.uint64)) for x in (a, b)])
            begin = np.array([0, len(a), len(a) + len(b)])
            row, key = ngram_join.keys_of(v, begin, 85)
            assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())
            assert ngram_join.links(v, begin, 85) in ([(0, 1)], [(1, 0)])
    assert linked > 700


def test_ngram_join_edges(spark, empty):
    assert ngram_join.joined(empty).count() == 0
    rows = spark.createDataFrame([(3, "p q r s t"), (3, "p q r s t"), (2, "P Q R S T"), (None, "p q r s t"), (9, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.joined(rows).collect()} == {2: 2, 3: 2, 9: 9}
    assert sorted(str(r["doc_id"]) for r in ngram_join.one_of_each(rows).collect()) == ["2", "9", "None"]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 520)] + [(1000, k) for k in range(1001, 1100)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_toxicity(spark, empty):
    rng = random.Random(5)
    mild, bad = ["fine", "house", "tree", "walk", "blue"] + [f"w{k}" for k in range(200)], ["foul", "vile", "rotten"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(mild) for _ in range(rng.randrange(5, 60))]
        if i % 5 == 0:
            for _ in range(rng.randrange(1, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "Foul! vile, ROTTEN foul vile"), (902, "Foul! vile, ROTTEN foul vile")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([x for x in labels if x[0] < 400] + [(None, 1), (3, None)], "doc_id long, toxic int"))
    assert (np.diff(model.thresholds) > 0).all()
    out = by_id(toxicity.scored(docs, model))
    held = [(out[i]["toxic"], bool(y)) for i, y in labels if i >= 400]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert not any(a for a, b in held if not b)
    assert not out[900]["toxic"] and not out[901]["toxic"] and out[902]["severity"] >= 2
    assert toxicity.scored(empty, model).count() == 0
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert {r["expected_severity"] for r in toxicity.scored(docs, None).collect()} == {0.0}


def test_ordinal_likelihood():
    """The fit is where the gradient of the plainly written loss vanishes; grades use the
    words of the other half."""
    rng = np.random.default_rng(3)
    x = rng.random((300, 6)) < 0.3
    toxic = rng.random(300) < 1 / (1 + np.exp(2 - 2.5 * x[:, 0] - 1.5 * x[:, 1]))
    row, col = np.nonzero(x)
    times, half = rng.integers(1, 4, len(row)), rng.integers(0, 2, 300)
    z = np.array([[5.0, 4, -1, 1, -2, 0.5], [5.0, -3, 2, -1, 1, 0.5]])
    grade = toxicity.grades(row, col, times, toxic, z, half)
    amount = [sum(t for r, c, t in zip(row, col, times, strict=True) if r == i and z[1 - half[i], c] > 0) for i in range(300)]
    cuts = np.quantile([a for a, y in zip(amount, toxic, strict=True) if y], [1 / 3, 2 / 3])
    assert grade.tolist() == [0 if not y else 1 + (a > cuts[0]) + (a > cuts[1]) for a, y in zip(amount, toxic, strict=True)]
    model = toxicity.fit_arrays(row, col, times, toxic, np.arange(6, dtype=np.uint64), z, half, rounds=2000)

    def loss(w, theta):
        total = 0.0
        for i in range(300):
            below = [0.0, *(1 / (1 + math.exp(-(t - float(x[i] @ w)))) for t in theta), 1.0]
            total -= math.log(below[grade[i] + 1] - below[grade[i]])
        return total / 300 + toxicity.RIDGE / 2 * float(w @ w)

    here = loss(model.weights, model.thresholds)
    for k in range(6):
        for step in (-0.05, 0.05):
            assert loss(model.weights + step * (np.arange(6) == k), model.thresholds) > here
    for k in range(3):
        for step in (-0.05, 0.05):
            assert loss(model.weights, model.thresholds + step * (np.arange(3) == k)) > here
    e, p = model.severity(x @ model.weights)
    for i in range(20):
        above = [1 - 1 / (1 + math.exp(-(t - float(x[i] @ model.weights)))) for t in model.thresholds]
        assert e[i] == pytest.approx(sum(above)) and p[i] == pytest.approx(above[0])


def test_toxicity_of_odd_rows(spark):
    rows = [(None, "foul vile", 1.0, "a"), (1, "foul " * 40_000, 2.0, "b"), (1, "other", None, None), (2, None, 3.0, "c"), *((k, "foul vile" if k % 5 == 0 else f"fine{k} tree{k}", 0.0, "d") for k in range(3, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic double, keys string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0), "x") for k in range(3, 80)] + [(3, 1, "x"), (2, 1, "y"), (None, 1, None)], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    out = toxicity.scored(docs, model).collect()
    assert len(out) == len(rows)
    assert {(str(r["doc_id"]), r["toxic"]) for r in out if r["doc_id"] is None or r["doc_id"] < 5} == {("None", True), ("1", True), ("1", False), ("2", False), ("3", False), ("4", False)}
    assert toxicity.fit(docs, labels.where("doc_id = 3")) is None


def test_licenses_by_text(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, gpl + " one", "k", 5), (1, "two " + gpl, "k", 5), (1, "two " + gpl, "k", 5), (None, gpl, None, None), (None, "All rights reserved.", "k", 1), (2, "z " * 60_000 + gpl, "k", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license_id string, shape int")
    got = sorted((str(r["doc_id"]), r["license_id"], r["start"], r["n_windows"]) for r in license_scan.matches(docs).collect())
    assert [g[:2] for g in got] == [("1", "gpl-3.0"), ("1", "gpl-3.0"), ("2", "gpl-3.0"), ("None", "all-rights-reserved"), ("None", "gpl-3.0")]


def test_telling_words_hit_every_shingle():
    rng = random.Random(8)
    grams = [tuple(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(1, 6))) for _ in range(200)]
    words = set(license_scan.telling_words(grams))
    assert all(words & set(g) for g in grams)


def test_licenses(spark, empty):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "x " * 50 + "All  rights\nRESERVED. y"), (2, "a b " + gpl + " c"), (3, "foo " + gpl.replace("version", "edition")), (4, "this work is licensed"), (5, None), (6, ""), (1, "x " * 50 + "All  rights\nRESERVED. y"), (7, gpl + " " + "z " * 300 + "Released under the MIT License."), (8, gpl.replace("GNU", "XYZ"))]
    out = license_scan.matches(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], r["license_id"]): (r["containment"], r["start"]) for r in out.collect()}
    words = {n: ALNUM.findall(low(t)) for n, t in license_scan.TEMPLATES}

    def share(t, w):
        k = min(5, len(t))
        a = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        return len(a & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) / len(a)

    want = {(i, n) for i, t in rows for n, lic in words.items() if share(lic, ALNUM.findall(low(t or ""))) >= 0.8}
    assert set(got) == want
    assert got[1, "all-rights-reserved"] == (1.0, 50)
    assert license_scan.matches(empty).count() == 0
    assert license_scan.matches(spark.createDataFrame(rows, "doc_id long, text string"), templates=(("none", " "),)).count() == 0


def test_common_licenses(spark):
    texts = dict(license_scan.TEMPLATES)
    say = lambda k: " ".join(f"w{(k * 7919 + i * i) % 997}" for i in range(k))
    names = ["mit-text", "bsd-3-clause-text", "mpl-2.0-header", "lgpl-3.0-header", "apache-2.0-header", "cc-by-4.0-notice", "gpl-3.0-text", "cc-by-sa-4.0"]
    rows = [(k, f"{say(40 + 30 * k)} {texts[n]} {say(60)}") for k, n in enumerate(names)]
    rows += [(10, f"{say(9)} " + texts["mit-text"].replace("furnished", "given").upper()), (11, say(500)), (12, texts["bsd-2-clause-text"][:300]), (13, f"{say(3000)} {texts['apache-2.0-header'].replace('Unless', 'If not')}")]
    out = license_scan.matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["license_id"]): r["containment"] for r in out}

    def share(t, w):
        k = min(5, len(t))
        a = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        return len(a & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) / len(a)

    want = {(i, n): share(ALNUM.findall(low(lic)), ALNUM.findall(low(t))) for i, t in rows for n, lic in texts.items()}
    want = {k: c for k, c in want.items() if c >= 0.8}
    assert {(k, n) for k, n in enumerate(names)} | {(10, "mit-text"), (13, "apache-2.0-header")} <= set(want)
    assert set(got) == set(want) and all(got[k, n] == 1 for k, n in enumerate(names))
    assert all(got[k] <= want[k] + 1e-9 for k in want)  # a window may hold less than the whole text: BSD's two clauses among its three


def test_license_bands_reach_their_probability():
    for n in range(1, 300):
        s = license_scan.shape(n)
        need = math.ceil(0.8 * s.m - 1e-9)
        if s.bands > 1:
            j = need / (s.m + s.width - need)
            assert 1 - (1 - j) ** s.bands >= license_scan.RECALL
        else:
            assert need == s.m == s.width and s.stride == 1


def test_encoding_is_that_of_tokenizers():
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(encode.tokenizer_path())
    one.encode_special_tokens = True
    rng = random.Random(3)
    texts = [t for _, t in corpus()] + ["".join(rng.choice(" \n\tab'slt7!?.,ß\x1c\x85日本　\r") for _ in range(rng.randrange(0, 30))) for _ in range(1500)] + ["<|endoftext|> x", "don't"]
    ids, n = encode.encode_chunk(pa.array(texts, pa.large_string()), encode.tokenizer_path())
    at = np.concatenate([[0], np.cumsum(n)])
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == (one.encode(t, add_special_tokens=False).ids if t else [])


def test_token_counts(spark, docs, empty):
    n = [r["length"] for r in token_counts.lengths(docs).collect()]
    hist = token_counts.histogram(token_counts.lengths(docs))
    for r in token_counts.answers(hist).collect():
        x = r["length"]
        assert r["n_docs"] == n.count(x)
        assert r["docs_longer"] == sum(k > x for k in n) and r["tokens_longer"] == sum(k for k in n if k > x)
        assert r["tokens_truncated"] == sum(min(k, x) for k in n)
    asked = spark.createDataFrame([(k,) for k in (0, 1, 7, 7, 100, 10**6, None)], "length long")
    got = {r["length"]: r for r in token_counts.answers(hist, asked).collect()}
    assert set(got) == {0, 1, 7, 100, 10**6, *n}
    for x, r in got.items():
        assert (r["docs_longer"], r["tokens_longer"], r["tokens_truncated"]) == (sum(k > x for k in n), sum(k for k in n if k > x), sum(min(k, x) for k in n))
        assert r["quantile"] == pytest.approx(sum(k <= x for k in n) / len(n))
    assert token_counts.quantile(hist, 0.5) == sorted(n)[math.ceil(len(n) / 2) - 1]
    assert token_counts.truncated_total(hist, 37) == sum(min(k, 37) for k in n)
    assert token_counts.answers(token_counts.histogram(token_counts.lengths(empty))).count() == 0
    assert token_counts.truncated_total(token_counts.histogram(token_counts.lengths(empty)), 5) == 0


def test_quality_statistics(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (None, 0), (1, None)], "doc_id long, bad int")
    got = by_id(quality_rules.judged(docs, labels))
    for i, t in corpus():
        t = t or ""
        w = SPACE.findall(t)
        at = collections.defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        cover = {p + j for v in at.values() if len(v) > 1 for p in v for j in range(3)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert r["kept"] == (not r["base_failed"])
    assert quality_rules.judged(empty, labels).count() == 0


def test_quality_rules_are_learnt(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + ("$$$" if bad else "") for _ in range(80)]
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    labels = spark.createDataFrame(labels, "doc_id long, bad int")
    rules = quality_rules.fit(docs, labels)
    assert 1 <= len(rules) <= 2
    assert {r["doc_id"] for r in quality_rules.kept(docs, labels).collect()} == {i for i in range(400) if i % 4}
    assert quality_rules.kept(docs, labels).columns == docs.columns


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination(spark, docs, empty, most):
    texts = dict(corpus())
    w2 = texts[2].split()
    items = [(1, " ".join(w2[35:60])), (12, "One"), (3, " ".join(w2[40:52]).upper()), (4, None), (5, " ,. "), (6, "no such words at all in any of these texts here"), (7, "a-b")]
    items += [(1, " ".join(w2[35:60])), (8, " ".join(w2[35:46]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.contamination(docs, bench, broadcast_bytes=most))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t or ""))
        for k in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[k : k + 10])].add(str(i))
    for i, t in corpus():
        w = ALNUM.findall(low(t or ""))
        hit, found = set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if len(w[k : k + n]) == n and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    clean = decontaminate.decontaminated(docs, bench, broadcast_bytes=most)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, r in got.items() if not r["contaminated"]}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, bench, broadcast_bytes=most).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, none, broadcast_bytes=most).collect())


@pytest.mark.parametrize("most", [0, decontaminate.BROADCAST_BYTES])
def test_decontamination_of_null_ids(spark, most):
    leak = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(None, "x " + leak), (None, "clean words only"), (1, leak + " y"), (2, "z")], "doc_id long, text string")
    items = spark.createDataFrame([(7, leak)], "item_id long, text string")
    out = decontaminate.contamination(docs, items, broadcast_bytes=most).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in out) == [("1", 12, 11), ("2", 1, 0), ("None", 3, 0), ("None", 12, 11)]
    kept = decontaminate.decontaminated(docs, items, broadcast_bytes=most).collect()
    assert sorted(r["text"] for r in kept) == ["clean words only", "z"]


def test_packing(spark, docs, empty):
    out = packing.packed(docs, 256).collect()
    ids, n = encode.encode_chunk(pa.array([t for _, t in corpus()], pa.large_string()), encode.tokenizer_path())
    at = np.concatenate([[0], np.cumsum(n)])
    own = {i: np.append(ids[at[k] : at[k + 1]], 0).astype("<u4") for k, (i, _) in enumerate(corpus())}
    per, by = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        per[r["doc_id"]].append(r)
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(per) == set(own)
    for i, rows in per.items():
        rows.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows)))
        place = 0
        for r in rows:
            assert r["start"] == place and zlib.crc32(own[i][place : place + r["length"]].tobytes()) == r["ids_crc32"]
            place += r["length"]
        assert place == len(own[i]) and all(r["length"] == 256 for r in rows[1:]) and (len(rows) == 1 or len(own[i]) > 256)
    for s in by.values():
        s.sort()
        assert s[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(s, s[1:], strict=False)) and sum(k for _, k in s) <= 256
    assert len(by) <= -(-sum(map(len, own.values())) // 256) + 3
    assert packing.packed(empty, 256).count() == 0


def test_configurations():
    rng = np.random.default_rng(0)
    counts = np.bincount(np.minimum(rng.geometric(1 / 40, 3000), 200), minlength=201)
    counts[0] = 0
    plan = packing.configurations(counts, 200)
    assert (sum(u * k for u, k in plan) == counts).all()
    assert all((u * np.arange(201)).sum() <= 200 for u, _ in plan)
    assert sum(k for _, k in plan) <= -(-int((counts * np.arange(201)).sum()) // 200) + 2
    prices = rng.random(201)
    best = packing.dearest(prices, np.full(201, 999), 200)
    value = [0.0] * 201
    for room in range(1, 201):
        value[room] = max([value[room - 1], *(value[room - k] + prices[k] for k in range(1, room + 1))])
    assert (best * prices).sum() == pytest.approx(value[200])


@pytest.mark.parametrize("length", [5, 13])
def test_substring_dedup(spark, docs, empty, length):
    got = by_id(substring_dedup.digests(docs, length=length, heavy=3))
    first = {}
    for i, t in sorted(corpus()):
        w = SPACE.findall(t or "")
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    removed = 0
    for i, t in corpus():
        w = SPACE.findall(t or "")
        gone = {k + j for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < i for j in range(length)}
        removed += len(gone)
        r = got[i]
        assert (r["n_words"], r["n_removed"]) == (len(w), len(gone))
        assert r["kept_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert removed > 500
    assert substring_dedup.digests(empty, length=length).count() == 0


def test_substring_dedup_of_one_long_group(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(i, f"p{i} " + text + f" q{i}") for i in range(300)] + [(None, text), (7, None)], "doc_id long, text string")
    rows = [(r["doc_id"], r["n_removed"]) for r in substring_dedup.digests(docs.repartition(20)).collect()]
    assert sorted(rows, key=str) == sorted([(0, 0), (None, 0), (7, 0), *((i, 40) for i in range(1, 300))], key=str)
    out = substring_dedup.deduplicated(docs.where("doc_id < 3 and text is not null").selectExpr("*", "9L as n_chars"))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}[1] == ("p1 q1", 5)


def test_url_filter(spark):
    urls = [
        "http://www.example.com/en/1", "https://a.www.example.com/en/", "http://X.Example.com/en/2?q", "http://example.com/fr/3", "http://b.net/es/", "http://b.net/de/#x", "http://net/es/1",
        "http://notexample.com/en/", "http://example.com", "no scheme", None, "", "://h/p", "ftp://H?x/y", "http://x.org/en/1://z",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, none).collect()}
    hosts = [(r["host"], r["path"]) for _, r in sorted(got.items())]
    assert hosts[0] == ("www.example.com", "/en/1") and hosts[2] == ("x.example.com", "/en/2") and hosts[9:12] == [("", "")] * 3 and hosts[12] == ("h", "/p") and hosts[13] == ("h", "")
    assert [got[k]["rule"] for k in range(9)] == ["www.example.com/en/", "www.example.com/en/", "example.com/en/", "com/", "net/es/", None, "net/es/", "com/", None]
    assert [got[k]["verdict"] for k in (0, 2, 4, 5)] == ["allow", "block", "block", "allow"]
    rows = [(1000 + k, f"http://h{k % 20}.bad.org/x") for k in range(200)] + [(2000 + k, f"http://h{k % 20}.good.org/x") for k in range(200)] + [(5000, "http://new.bad.org/"), (5001, "http://h3.bad.org/n")]
    out = [(k, int(1000 <= k < 2000 and k % 10 != 0)) for k, _ in rows if k < 5000]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(out + [(None, 1), (1001, None)], "page_id long, bad int")).collect()}
    assert got[5001]["verdict"] == "block" and got[2005]["verdict"] == "allow"
    assert got[1003]["bad_rate"] > got[2003]["bad_rate"]


def test_hosts_without_labels_take_the_reputation_above(spark):
    rows = [(1000 + k, f"http://h{k % 20}.bad.org/x") for k in range(200)] + [(2000 + k, f"http://h{k % 20}.good.org/x") for k in range(200)] + [(3000 + k, f"http://h{k}.d{k}.biz/") for k in range(200)]
    new = [(5000, "http://new.bad.org/"), (5001, "http://new.good.org/"), (5002, "http://new.biz/"), (5003, "http://new.info/"), (5004, "no scheme"), (5005, "http://new.bad.org/2"), (5005, "http://new.bad.org/2")]
    out = [(k, int(not 2000 <= k < 3000 and k % 10 != 0)) for k, _ in rows]
    pages = spark.createDataFrame(rows + new, "page_id long, url string")
    judged = url_filter.judge(pages, spark.createDataFrame(out, "page_id long, bad int")).collect()
    assert len(judged) == len(rows) + len(new)
    got = {r["page_id"]: r for r in judged}
    assert [got[5000 + k]["verdict"] for k in range(6)] == ["block", "allow", "block", "block", "allow", "block"]
    assert abs(got[5003]["bad_rate"] - 360.5 / 601) < 1e-9 and got[5004]["bad_rate"] is None
    assert got[5003]["p_bad"] == pytest.approx(beta_above(360.5, 240.5, 0.5), abs=1e-6)


def beta_above(a, b, rate, cells=400_000):
    """By the density itself, summed over its variable."""
    t = (np.arange(cells) + 0.5) / cells
    density = (a - 1) * np.log(t) + (b - 1) * np.log1p(-t)
    density = np.exp(density - density.max())
    return float(density[t > rate].sum() / density.sum())


def test_posterior_tails(spark):
    from pyspark.sql import functions as F

    cases = [(1.0, 1.0, 0.5), (2.5, 7.0, 0.5), (40.0, 30.0, 0.5), (400.0, 300.0, 0.5), (3.0, 1.5, 0.9), (900.0, 1100.0, 0.4), (2.0, 50.0, 0.1), (1.2, 1.1, 0.05)]
    for a, b, rate in cases:
        got = spark.range(1).select(url_filter.above(F.lit(a), F.lit(b), rate)).first()[0]
        assert got == pytest.approx(beta_above(a, b, rate), abs=2e-4), (a, b, rate)
    got = spark.range(1).select(url_filter.above(F.lit(0.05), F.lit(0.05), 0.5)).first()[0]
    assert got == pytest.approx(0.5, abs=1e-9)
    assert spark.range(1).select(url_filter.above(F.lit(5000.0), F.lit(10.0), 0.5)).first()[0] == pytest.approx(1)


def test_url_filter_of_odd_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    marks = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "page_id long, bad int")
    assert url_filter.judge(none, marks).count() == 0
    rows = [(1, "http://h/" + "x" * 300_000, "a", 1.0), (None, "http://h/", None, None), (None, None, "b", 2.0), (1, "http://h/" + "x" * 300_000, "a", 1.0), (2, "http://a.co.uk/", "c", 0.0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, bad double")
    out = url_filter.judge(pages, marks, long_suffixes=())
    assert sorted((str(r["page_id"]), r["host"], len(r["path"])) for r in out.collect()) == [("1", "h", 300_001), ("1", "h", 300_001), ("2", "a.co.uk", 1), ("None", "", 0), ("None", "h", 1)]


def test_substring_dedup_of_odd_rows(spark):
    run = [f"w{k}" for k in range(30)]
    rows = [(5, " ".join(run)), (5, " ".join(run)), (5, "x " + " ".join(run)), (7, "y " + " ".join(run[:20])), (8, None), (None, " ".join(run)), (9, " ".join(["a"] * 3000)), (10, " ".join(["a"] * 20))]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, th int, key string")
    got = sorted(((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.digests(docs).collect()))
    assert got == sorted([("5", 30, 0), ("5", 30, 0), ("5", 31, 0), ("7", 21, 20), ("8", 0, 0), ("None", 30, 0), ("9", 3000, 0), ("10", 20, 20)])


def test_suffix_trees_share_prefixes():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 3, 400).astype(np.uint32)
    start, group = np.arange(380), rng.integers(0, 4, 380)
    order, shared = substring_dedup.suffix_trees(ids, start, group, 9)
    key = lambda k: (group[k], *ids[start[k] : start[k] + 9].tolist())
    assert [key(k) for k in order] == sorted(key(k) for k in range(380))
    for a, b, n in zip(order, order[1:], shared[1:], strict=False):
        x, y = key(a), key(b)
        same = next((k for k in range(10) if x[k] != y[k]), 10)
        assert n == same - 1


def test_rows_without_ids_and_repeated_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (3, "a b c"), (3, "a b c"), (4, None)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, length int")
    assert sorted(str(r["doc_id"]) for r in token_counts.lengths(docs).collect()) == ["3", "3", "4", "None", "None"]
    packed = packing.packed(docs, 64).collect()
    assert sorted(str(r["doc_id"]) for r in packed) == ["3", "3", "4", "None", "None"] and len({r["sequence_id"] for r in packed}) == 1
    labels = spark.createDataFrame([(3, 1), (None, 0)], "doc_id long, bad int")
    assert sorted(str(r["doc_id"]) for r in quality_rules.judged(docs, labels).collect()) == ["3", "3", "4", "None", "None"]
    items = spark.createDataFrame([(None, "b c"), (1, "a b")], "item_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, items).collect()) == [("3", 3, 1), ("4", 0, 0), ("None", 3, 1)]


def test_a_rule_grows_by_the_highest_gain():
    """The first condition against all thresholds, tried one by one."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (200, 9)).astype(float)
    bad = (x[:, 2] >= 8) & (rng.random(200) < 0.9) | (rng.random(200) < 0.1)
    rule = quality_rules._grow(x, bad, 1, 500)
    best = 0.0
    for f in range(9):
        for t in set(x[:, f]):
            for take in (x[:, f] >= t, x[:, f] <= t):
                if bad[take].any() and take.sum() < 200:
                    best = max(best, bad[take].sum() * (np.log2(bad[take].mean()) - np.log2(bad.mean())))
    c = rule.covers(x)
    assert bad[c].sum() * (np.log2(bad[c].mean()) - np.log2(bad.mean())) == pytest.approx(best)


def test_packing_near_its_bound():
    for low_, high_, n in ((600, 1100, 9000), (1, 2048, 5000)):
        counts = np.bincount(np.random.default_rng(0).integers(low_, high_ + 1, n), minlength=2049)
        plan, bound = packing.packing_plan(counts, 2048, rounds=128)
        used = sum(t for _, t in plan)
        assert (sum(u * t for u, t in plan) == counts).all() and all((u * np.arange(2049)).sum() <= 2048 for u, _ in plan)
        assert bound <= used <= sum(t for _, t in packing.best_fit(counts, 2048))
        assert used <= (1.07 if low_ > 1 else 1.01) * bound


def test_reputation_shrinks_towards_the_domain(spark):
    rows = [(f"h{k}.d.org", int(k % 2)) for k in range(40) for _ in range(10)] + [("one.d.org", 1), ("one.e.org", 1)] + [(f"g{k}.e.org", 0) for k in range(40) for _ in range(10)]
    t = {r["host"]: r["a"] / (r["a"] + r["b"]) for r in url_filter.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert t["one.e.org"] < t["one.d.org"] < 1
