import random

import numpy as np
import pytest
import xxhash

from orrery.llm import common, components, embeddings, simhash


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_by_contraction(spark):
    rnd = random.Random(5)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    rest = [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    pairs = chain + star + rest
    want = union(400, pairs)
    df = spark.createDataFrame(pairs, "a long, b long")
    for bound in (100_000, 3):
        got = {r.node: r.root for r in components.components(df, bound).collect()}
        linked = {x for a, b in pairs if a != b for x in (a, b)}
        assert set(got) == linked
        by = {}
        for node, root in got.items():
            by.setdefault(root, set()).add(node)
        assert sorted(map(sorted, by.values())) == sorted(sorted(x for x in linked if want[x] == r) for r in {want[x] for x in linked})
    assert components.components(df.limit(0)).count() == 0


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_fingerprints():
    for t in (None, "", " \n", "One", "One two", "One two three", "ÄB a b c  D", "a b " * 40_000, "x\x1cy z\x85w v"):
        assert simhash.fingerprint(t) == brute_print(t), t


def test_near_pairs_are_exact(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.concatenate([base, *(base ^ (np.uint64(1) << rnd.integers(0, 64, 60, dtype=np.uint64)) for _ in range(4)), [np.uint64(1) << np.uint64(i) for i in range(64)]])
    a = np.unique(near)
    want = {(int(x), int(y)) for i, x in enumerate(a) for y in a[i + 1 :] if bin(int(x) ^ int(y)).count("1") <= 2}
    got = {tuple(sorted((int(x), int(y)))) for p, q in simhash.near_pairs(a, None, 2) for x, y in zip(p, q, strict=True)}
    assert got == want
    tree = simhash.VantageTree(a, 3)
    seen, homes = set(), 0
    for _, home, guest in tree.route(a, 2):
        homes += home.size
        for pairs in (simhash.near_pairs(home, None, 2), simhash.near_pairs(home, guest, 2)):
            seen |= {tuple(sorted((int(x), int(y)))) for p, q in pairs for x, y in zip(p, q, strict=True)}
    assert homes == a.size and seen == want


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(4))
    texts = [None, "", "a"]
    for _ in range(20):
        t = [word() for _ in range(300)]
        texts.append(" ".join(t))
        for _ in range(3):
            t = list(t)
            t[rnd.randrange(300)] = word()
            texts.append(" ".join(t))
    texts += texts[-5:]
    prints = [brute_print(t) for t in texts]
    root = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string, component_id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in range(len(texts))}
    kept = [r.doc_id for r in simhash.one_of_each(df.union(df)).collect()]
    assert sorted(kept) == sorted(set(root))
    for bits in (24, 6):  # with few bits many kept rows are in doubt
        monkeypatch.setattr(common, "SLOT_BITS", bits)
        assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == sorted(set(root))
    assert simhash.one_of_each(df.limit(0)).columns == df.columns and simhash.one_of_each(df.limit(0)).count() == 0
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("interval", "ranges"), [(256, 1 << 16), (2, 1 << 16), (4, 3)])
def test_vectors(spark, monkeypatch, interval, ranges):
    monkeypatch.setattr(embeddings, "SEGMENT", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "INTERVAL", interval)
    monkeypatch.setattr(embeddings, "RANGES", ranges)
    rnd = np.random.default_rng(6)
    centres = rnd.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] * rnd.uniform(0.5, 2) + rnd.normal(0, 0.18, 16)).astype(np.float32).tolist(), int(i % 30 % 3)) for i in range(400)]
    rows += [(500 + i, rows[5][1], 2) for i in range(7)] + [(507, rows[5][1], None), (508, None, 1), (509, [0.0] * 16, 1), (510, [float("nan")] + [1.0] * 15, 1), (511, [None] + [1.0] * 15, 1), (512, [], 1), (513, rows[5][1][:8], 2), (3, rows[5][1], 2)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    ok = [r[2] is not None and r[1] is not None and len(r[1]) == 16 and None not in r[1] and bool(np.isfinite(r[1]).all()) and any(r[1]) for r in rows]
    unit = np.array([np.array(r[1], float) / np.linalg.norm(r[1]) if k else np.zeros(16) for r, k in zip(rows, ok, strict=True)])
    near = (unit @ unit.T >= 0.93) & (np.array([r[2] if r[2] is not None else -1 for r in rows])[:, None] == np.array([r[2] if r[2] is not None else -1 for r in rows])[None, :])
    np.fill_diagonal(near, False)
    assert near.sum() > 1000
    root = union(len(rows), [(i, j) for i, j in zip(*np.nonzero(near), strict=True)])
    lowest = {}
    for i, r in enumerate(rows):
        lowest[root[i]] = min(lowest.get(root[i], 1 << 40), r[0])
    want = sorted((r[0], int(near[i].sum()), lowest[root[i]], r[0] == lowest[root[i]]) for i, r in enumerate(rows))
    assert sorted(tuple(r) for r in embeddings.near_duplicates(df).collect()) == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_plan_of_pairs_loses_none():
    rnd = np.random.default_rng(7)
    low = rnd.uniform(0, 10, (60, 3))
    high = low + rnd.uniform(0, 2, (60, 3))
    gap = np.maximum(0, np.maximum(low[:, None] - high[None], low[None] - high[:, None]))
    want = {(i, j) for i, j in zip(*np.nonzero((gap**2).sum(axis=2) <= 4), strict=True) if i <= j}
    assert set(embeddings.plan_pairs(low, high, 2.0)) == want
    assert set(embeddings.plan_pairs(low, high, 2.0, 25)) == {(i, j) for i, j in want if i < 25 <= j}
