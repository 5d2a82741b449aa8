"""Prefix trie, SetSketch near-dedup and filter audit against brute-force versions."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("meshframe.llm")

from meshframe.llm import filter_audit, license_scan, meeting, minhash_dedup, ngram_join, prefix_trie, quality_rules

from test_operators import SPACE, by_id, corpus, low


def said(seed=3, n=80):
    """conv_id, turn, role, text, other columns: shared openings, copies, nested prefixes,
    gaps in the ids, null turns, roles and texts, a long conversation."""
    rng = random.Random(seed)
    lines = ["hi", "", "é日", "what is this", None, "x" * 300]
    rows = []
    opening = [(rng.choice(["user", None]), rng.choice(lines)) for _ in range(6)]
    for c in range(n):
        if c % 7 == 3:
            continue
        kind = c % 4
        if kind == 0:
            turns = opening[: rng.randrange(0, 7)]
        elif kind == 1:
            turns = [(rng.choice(["user", "assistant"]), rng.choice(lines)) for _ in range(rng.randrange(1, 12))]
        elif kind == 2:
            turns = opening[:3] + [("user", f"own {c}")] * rng.randrange(0, 3)
        else:
            turns = [("system", "same")] + opening + [("user", "end")]
        rows += [(c, None if k == 0 and c % 3 == 0 else k, r, t, "z", c) for k, (r, t) in enumerate(turns)]
    rows += [(200, k, "user", f"line {k // 2}", "z", 1) for k in range(400)] + [(204, k, "user", f"line {k // 2}", "z", 1) for k in range(390)]
    rows += [(None, 0, "user", "nobody", "z", 1), (7, 50, "user", "twice", "z", 1), (7, 50, "user", "twice", "z", 1)]
    return rows


def trie_of(convs):
    """conv id -> list of (turn, bytes): the nodes by plain dictionaries."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        kids = [q for q in out if len(q) == len(p) + 1 and q[:-1] == p]
        own = (len(members[p]) - 1) * (p[-1][1] if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), sum(out[k][5] for k in kids) or 1, own + sum(out[k][6] for k in kids), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def rebuilt_of(rows):
    own = collections.defaultdict(list)
    for c, k, r, t, *_ in rows:
        if c is not None:
            own[c].append(((k is not None, k or 0), (r or "", t or "")))
    own = {c: [x[1] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: [(x, len(x[1].encode())) for x in own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :]] for c in own}


@pytest.mark.parametrize("local", [1, 6, 40, 1 << 14])
def test_trie(spark, local):
    rows = said()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string, parent int").repartition(5)
    got = sorted((tuple(r) for r in prefix_trie.nodes(df, local).collect()), key=str)
    assert got == trie_of(rebuilt_of(rows))


def test_trie_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.nodes(empty).count() == 0
    one = spark.createDataFrame([(5, None, None, None)], "conv_id int, turn int, role string, text string")
    assert sorted(tuple(r)[:5] for r in prefix_trie.nodes(one).collect()) == sorted(x[:5] for x in trie_of(rebuilt_of([(5, None, None, None)])))
    # a conversation and all its openings: every round sheds one member
    chain = spark.createDataFrame([(c, list(range(c)), [1] * c) for c in range(12)], "conv_id long, ids array<long>, sizes array<int>")
    got = sorted((tuple(r) for r in prefix_trie.trie(chain, 3).collect()), key=str)
    assert got == trie_of({c: [(k, 1) for k in range(c)] for c in range(12)})


def test_registers():
    rng = np.random.default_rng(5)
    draw = lambda k: np.unique(rng.integers(0, 2**63, size=k).astype(np.uint64))
    of = lambda *sets: minhash_dedup.registers(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    a, b = draw(900), draw(40)
    both = of(a, b, np.union1d(a, b), a[:0])
    assert (minhash_dedup.merged(both[0], both[1]) == both[2]).all()  # mergeable
    assert (both[3] == 0).all()
    assert (of(a)[0] == both[0]).all()  # whatever stands beside it in a chunk
    assert np.log(900 / 40) == pytest.approx((both[0].mean() - both[1].mean()) * np.log(minhash_dedup.BASE), abs=0.4)
    for share, ok in ((0.3, False), (0.85, True), (0.9, True)):
        found, kept = [], []
        for _ in range(40):
            x = draw(600)
            cut, own = int(len(x) * share), len(x) - int(len(x) * share)
            r = of(x[: cut + own // 3], np.concatenate([x[:cut], x[cut + own // 3 :]]))
            args = [np.array([v]) for v in (cut + own // 3, len(x) - own // 3, (r[0] > r[1]).sum(), (r[0] < r[1]).sum())]
            found.append(minhash_dedup.estimate(*args)[0])
            kept.append(bool(minhash_dedup.may_be_linked(*args, 85)[0]))
        assert np.mean(found) == pytest.approx(share, abs=0.02)
        assert all(kept) if ok else not any(kept)


def groups_of(rows, size, least):
    sets = {}
    for i, t in rows:
        w = SPACE.findall(low(t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= least * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies(seed=11):
    """Texts of all lengths, each with near copies around the threshold."""
    rng = random.Random(seed)
    rows = [(i, t) for i, t in corpus(n=40) if len(t or "") < 9000]
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 2, 3, 4, 7, 20, 60, 200, 500]))]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 30))):
                w[rng.randrange(len(w))] = "other"
            rows.append((1000 + len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("tile", [6, 2048])
def test_near_dedup(spark, tile):
    rows = copies()
    df = spark.createDataFrame([(i, t, i, "k") for i, t in rows], "doc_id long, text string, rep long, `a.b` string").repartition(5)
    got = by_id(minhash_dedup.joined(df, tile=tile))
    want = groups_of(rows, 3, 85)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    left = minhash_dedup.one_of_each(df, tile=tile)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_near_dedup_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.joined(empty).count() == 0
    same = " ".join(map(str, range(30)))
    rows = [(3, same), (3, same), (None, same), (9, None), (2, same), (4, "a b"), (5, "A b")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: (28, 2), 3: (28, 2), 4: (1, 4), 5: (1, 4), 9: (0, 9)}


def test_one_row_of_an_id(spark):
    """Several texts of one id: which one stays does not depend on the order of rows."""
    rows = [(1, "b c d e f", 1), (1, "a c d e f", 2), (1, "a c d e f", 1), (1, None, 0), (2, "z", 5), (None, "q", 1), (None, "q", 1)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, `a.b``c` int")
        for module in (ngram_join, minhash_dedup):
            got = sorted((tuple(r) for r in module.one_of_each(df).collect()), key=str)
            assert got == [(1, "a c d e f", 1), (2, "z", 5), (None, "q", 1), (None, "q", 1)]


def test_quality_rules_take_any_names(spark):
    df = spark.createDataFrame([(1, "word " * 3, 5), (2, " ".join(f"w{k}" for k in range(80)), 6)], "doc_id long, text string, `a.b``c` int")
    labels = spark.createDataFrame([], "doc_id long, bad int")
    assert [tuple(r) for r in quality_rules.kept(df, labels).select("doc_id", "`a.b``c`").collect()] == [(2, 6)]


def audit_of(rows, labels):
    words = [SPACE.findall(t or "") for _, t, _ in rows]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for (i, t, s), w in zip(rows, words, strict=True):
        t = t or ""
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        good = any(i is not None and x == i and q == 1 for x, q, _ in labels)
        toxic = any(i is not None and x == i and k == 1 for x, _, k in labels)
        fails.append((s or "", {k for k, v in f.items() if v}, good, toxic))
    out = []
    for part in {s for s, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        table = []
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = set()
            for k, f in enumerate(order):
                fail = [n for n, x in enumerate(own) if f in x[1]]
                now = [n for n in fail if n not in gone]
                back = len(fail) - len(now)
                gone |= set(now)
                table.append([order, k + 1, len(own) - len(gone), len(now), back, sum(x[1] == {f} for x in own), sum(own[n][2] for n in now), sum(own[n][3] for n in now)])
        total = collections.Counter()
        for r in table:
            total[r[0][r[1] - 1]] += r[3]
        out += [(part, *r, total[r[0][r[1] - 1]]) for r in table]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["a", "b", None, ""])) for i, t in corpus()]
    long = " ".join(f"w{k}" for k in range(900))
    rows += [(900 + k, t, "b") for k, t in enumerate([long, long, long + "x", "y" + long[1:], long[:-1] + "x", None, ""])]
    rows += [(900, long, "b"), (900, "again", "c"), (None, long, "a"), (None, None, None), (2000, "#" * 70, "a"), (2001, "É" * 70, "a"), (2002, "A" * 5 + "a" * 95, "a"), (2003, "A" * 6 + "a" * 94, "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 70, 2)] + [(4, 1, 1), (None, 1, 1), (5000, 1, 1)]
    docs = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, bits int, cls string").repartition(4)
    got = sorted(tuple(r) for r in filter_audit.audited(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect())
    assert got == audit_of(rows, labels)


def test_audit_edges(spark, monkeypatch):
    nothing = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audited(nothing, labels).count() == 0
    # classes in which texts differ although lengths and block hashes agree
    rows = spark.createDataFrame([(1, "ab"), (2, "ba"), (3, "ab"), (4, "ba"), (5, "ab"), (6, "abc")], "doc_id long, text string")
    monkeypatch.setattr(filter_audit, "class_of", lambda n, hashes: filter_audit.F.xxhash64(n))
    flat = spark.createDataFrame([(k, 2, []) for k in range(1, 6)] + [(6, 3, [])], "doc_id long, n long, blocks array<long>")
    assert sorted(r["doc_id"] for r in filter_audit.duplicates(rows, flat).collect()) == [3, 4, 5]


def test_blocks():
    text = bytes(range(256)) * 40
    assert filter_audit.blocks(b"") == []
    assert len(filter_audit.blocks(text)) == 4
    other = text[:9000] + b"!" + text[9001:]
    assert [x == y for x, y in zip(filter_audit.blocks(text), filter_audit.blocks(other), strict=True)] == [True, True, True, False]


def test_tiles_of_two_blocks_meet_all_pairs(spark):
    rows = spark.createDataFrame([(7, r) for r in range(50)], "key long, rep long")
    held = spark.createDataFrame([(7, 5)], "key long, blocks int")
    found = collections.defaultdict(set)
    for r in meeting.tiles_of_keys(rows, held).collect():
        found[r["t"]].add(r["rep"])
    assert {p for x in found.values() for p in itertools.combinations(sorted(x), 2)} == set(itertools.combinations(range(50), 2))


def test_licenses_with_accents(spark):
    """Letters that lower() changes and the operator's own lowering does not."""
    docs = spark.createDataFrame([(1, "x ÉCOLE Œuvre y"), (2, "école œuvre"), (3, "ΑΣ 許諾 ΟΔΟΣ"), (4, "none"), (5, "Public ÉCOLE")], "doc_id long, text string")
    templates = [("a", "ÉCOLE Œuvre"), ("b", "école œuvre"), ("c", "ΑΣ 許諾 ΟΔΟΣ"), ("d", "PUBLIC ÉCOLE")]
    got = sorted((r["doc_id"], r["license_id"]) for r in license_scan.matches(docs, templates).collect())
    assert got == [(1, "a"), (2, "b"), (3, "c"), (5, "d")]


def test_rules_learn_from_whole_rows(spark):
    """Several texts of one id: their counts are not mixed."""
    seen = []
    texts = [" ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(90)) + " #" * 9]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1])], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, bad int")
    learn = quality_rules.learn
    try:
        quality_rules.learn = lambda x, bad, grow, **k: seen.append(x.tolist()) or []
        quality_rules.fit(docs, labels)
    finally:
        quality_rules.learn = learn
    assert len(seen[0]) == 1
    assert seen[0][0][0] == 60 and seen[0][0][2] == 0
