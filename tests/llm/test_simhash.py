import random
import re

import numpy as np
import xxhash

from docsift.llm import components, simhash

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows):
    """``id, text`` to sorted (id, fingerprint, component)."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = groups(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    least = {}
    for r, (i, _) in zip(root, rows, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, f, least.get(r)) for (i, _), f, r in zip(rows, fps, root, strict=True)), key=str)


def found(frame):
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in frame.collect()), key=str)


def test_lagged_planes_against_pairs():
    rng = np.random.default_rng(1)
    fps = []
    for b in rng.integers(0, 2**63, 150).tolist():
        for _ in range(rng.integers(1, 12)):
            x = b
            for k in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << k
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    rng.shuffle(fps)
    group = np.sort(rng.integers(0, 5, len(fps)))
    want = groups(len(fps), lambda i, j: group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 3)
    assert simhash.linked(fps, group).tolist() == want


def test_masks_miss_no_pair():
    rng = random.Random(2)
    for n in (10, 10**7, 10**10):
        first = simhash.masks(n)
        for tree in (first, [w for m in first for w in simhash.wider(m)]):
            for _ in range(200):
                x = sum(1 << b for b in rng.sample(range(64), 3))
                assert any(not x & m for m in tree)


def test_components_of_odd_rows(odd, none):
    assert found(simhash.components(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.components(none).count() == 0


def test_hot_buckets(spark, monkeypatch):
    """Fingerprints that agree on most bits: buckets are dealt again, then compared in blocks."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    fps = sorted({base ^ int(x) << 40 for x in rng.integers(0, 2**18, 300)} | {base ^ int(x) for x in rng.integers(0, 2**16, 200)})
    monkeypatch.setattr(simhash, "LEVELS", 1)
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {frozenset((r.u % 2**64, r.v % 2**64)) for r in components.stars(simhash.links(nodes, limit=16)).collect()}
    root = groups(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    parts = {}
    for i, r in enumerate(root):
        parts.setdefault(r, set()).add(fps[i])
    joined = {}
    for u, v in map(tuple, got):
        joined.setdefault(u, {u}).update(joined.setdefault(v, {v}))
        for x in joined[u]:
            joined[x] = joined[u]
    assert {frozenset(p) for p in joined.values()} == {frozenset(p) for p in parts.values() if len(p) > 1}


def test_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "u long, v long")
    assert {(r.u, r.v) for r in components.stars(edges).collect()} == {(i, 0) for i in range(1, 201)} | {(501, 500)}


def test_keep_one(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    kept = simhash.keep_one(odd)
    want = {c for i, _, c in brute(rows) if i is not None}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1 and kept.columns == odd.columns
    assert simhash.keep_one(none).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.op8_simhash(spark, DATA).collect()), key=str)
    assert got == brute(docs)


def test_keys_with_many_rows_are_joined_by_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 90), (2, 5), (3, 1), (4, 30)) for i in range(n)] + [(9, 0)], "k long, i long")
    known = spark.createDataFrame([(1, "a", 90), (2, "b", 5), (3, "c", 1), (4, "d", 30), (5, "e", 7)], "k long, what string, n long")
    for few in (1, 20, 1000):
        monkeypatch.setattr(components, "FEW", few)
        scratch = []
        got = components.by_key(rows, known, "k", 127, scratch, 100)
        assert sorted(map(tuple, got.groupBy("k", "what").count().collect())) == [(1, "a", 90), (2, "b", 5), (3, "c", 1), (4, "d", 30)] and got.columns == ["k", "i", "what"]
        assert len(scratch) == 1 and ("Broadcast" in got._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in got._jdf.queryExecution().optimizedPlan().toString()) == (few < 1000)


def test_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 8)
    edges = spark.createDataFrame([(500, i) for i in range(1000, 1300)] + [(i, 20_000 + i) for i in range(1000, 1300, 7)] + [(3, 20_007 + 993)], "u long, v long")
    got = {(r.u, r.v) for r in components.stars(edges).collect()}
    nodes = {500, *range(1000, 1300), *(20_000 + i for i in range(1000, 1300, 7)), 21_000}
    assert got == {(u, 3) for u in nodes}
