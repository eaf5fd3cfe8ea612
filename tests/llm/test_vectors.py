"""Near-duplicate vectors and top-k search against brute force."""

import numpy as np
import pytest

from tokenguard.llm import near_dedup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute_components(n, pairs):
    reach = list(range(n))

    def top(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        reach[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def clustered(n, dim=16, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    x = centres[r.integers(0, 12, n)] + r.normal(size=(n, dim)) * r.choice([0.05, 0.25, 0.6], (n, 1))
    x[n // 2 : n // 2 + 40] = x[0]  # copies
    return x.astype(np.float32)


@pytest.mark.parametrize("n,chunk", [(700, 64), (300, 4096)])
def test_near_pairs(spark, monkeypatch, n, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    monkeypatch.setattr(near_dedup, "GROUP", 2 * chunk)
    x = clustered(n)
    x[n // 3] = 1e-30 * x[0]
    got = {r["vec_id"]: r for r in near_dedup.near_pairs(spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], SCHEMA)).collect()}
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    near = d @ d.T >= 0.9
    np.fill_diagonal(near, False)
    assert [got[i]["n_links"] for i in range(n)] == near.sum(1).tolist()
    want = brute_components(n, np.argwhere(near))
    assert [got[i]["component_id"] for i in range(n)] == want and all(got[i]["kept"] == (want[i] == i) for i in range(n))


@pytest.mark.parametrize("scale", [1, 3, 0.7, 1e-3, 1e200, 1e-200])
def test_cosine_of_exactly_the_threshold(spark, scale):
    rows = []
    for i, (a, b) in enumerate((([1, 0, 0, 0], [9, 1, 3, 3]), ([0, 2, 0, 0], [1, 9, 3, 3]), ([0, 0, 5, 0], [3, 3, 9, 1]))):
        rows += [(10 * i, [float(v) for v in a]), (10 * i + 1, [float(scale * v) for v in b])]
    want = {}
    for i, a in rows:
        one = np.ldexp(np.array(a), -int(np.frexp(max(a))[1]))
        want[i] = sum(float(np.dot(one, y := np.ldexp(np.array(b), -int(np.frexp(max(b))[1]))) / (np.sqrt(np.dot(one, one)) * np.sqrt(np.dot(y, y)))) >= 0.9 for j, b in rows if i != j)
    got = {r["vec_id"]: r["n_links"] for r in near_dedup.near_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == want
    if scale in (1, 3):
        assert set(got.values()) == {1}


def test_tight_leaves_are_counted_by_their_sums(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 40)
    monkeypatch.setattr(near_dedup, "GROUP", 48)
    r = np.random.default_rng(11)
    base = r.normal(size=(5, 12))
    base[1] = base[0] + 0.05 * r.normal(size=12)
    x = np.concatenate([base[[0] * 200 + [1] * 150 + [2] * 60] + 0.004 * r.normal(size=(410, 12)), base[r.integers(0, 5, 150)] + 0.4 * r.normal(size=(150, 12))])
    got = {row["vec_id"]: row for row in near_dedup.near_pairs(spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], SCHEMA.replace("float", "double"))).collect()}
    d = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = d @ d.T >= 0.9
    np.fill_diagonal(near, False)
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == brute_components(len(x), np.argwhere(near))


def cells(spark, x):
    unique = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "uid long, x array<double>, copies long")
    _, leaves, pairs = near_dedup.upper_levels(unique, (2 - 1.8) ** 0.5, 512)
    return near_dedup.cells_of(pairs.select("a", "b"), near_dedup.packed(leaves, 64)).count()


@pytest.fixture
def small_nodes(monkeypatch):
    for name, value in (("CHUNK", 32), ("GROUP", 64), ("GROUP_BYTES", 0)):
        monkeypatch.setattr(near_dedup, name, value)


@pytest.mark.parametrize("seed", range(10))
def test_every_cluster_of_a_sample_has_a_centre(seed):
    r = np.random.default_rng(seed)
    x = near_dedup.unit(np.repeat(np.linalg.qr(r.normal(size=(64, 64)))[0][:32], 64, axis=0) + 0.03 * r.normal(size=(64 * 32, 64)))
    sample = r.permutation(len(x))[:1024]
    centres = sample[near_dedup.farthest_first(x[sample], (2 - 1.8) ** 0.5, 100_000)]
    assert {c // 64 for c in centres.tolist()} == set(range(32)) and len(centres) < 128


@pytest.mark.parametrize("seed", [0, 2])
def test_cells_grow_with_the_vectors_where_they_are_clustered(spark, small_nodes, seed):
    r = np.random.default_rng(seed)
    x = np.repeat(np.linalg.qr(r.normal(size=(64, 64)))[0][:32], 64, axis=0) + 0.03 * r.normal(size=(64 * 32, 64))
    assert cells(spark, x) <= 112  # 32 groups make 528 pairs


def test_trees_count_exactly():
    x = near_dedup.unit(clustered(1500, seed=3).astype(float))
    links = near_dedup.Links(x, np.ones(len(x), np.int64), 0.9)
    links.within(near_dedup.tree(x, np.arange(len(x))))
    near = x @ x.T >= 0.9
    assert (links.count == near.sum(1) - 1).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0], 0, ""), (3, [2.0, 0.0], 0, ""), (3, [2.0, 0.0], 0, ""), (1, None, 0, ""), (2, [0.0, 0.0], 0, ""), (4, [nan, 1.0], 0, ""), (6, [inf, 1.0], 0, ""), (7, [None, 1.0], 0, ""), (8, [], 0, ""), (9, [-0.0, 1.0], 0, ""), (10, [0.0, 1.0], 0, ""), (11, [1.0, 0.0, 0.0], 0, ""), (None, [1.0, 0.0], 0, "")]
    got = sorted((tuple(r) for r in near_dedup.near_pairs(spark.createDataFrame(rows, SCHEMA)).collect()), key=lambda r: r[0] or 0)
    assert got == [(None, 0, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (3, 2, 3, True), (4, 0, 4, True), (5, 2, 3, False), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 1, 9, True), (10, 1, 9, False), (11, 0, 11, True)]
    assert near_dedup.near_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_top(ids, vectors, asked, k):
    q = np.floor(1024 * vectors.astype(np.float64)).astype(np.int64)
    s = q @ q.T
    out = []
    for i in asked:
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out += [(ids[i], rank + 1, ids[j], int(s[i, j])) for rank, j in enumerate(order)]
    return sorted(out)


def test_search(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 150)
    monkeypatch.setattr(topk, "QUERIES", 8)
    x = clustered(900, dim=40, seed=7)
    x[300:330] = x[5]  # ties
    df = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], SCHEMA)
    got = sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0 OR vec_id = 5")).collect())
    assert got == brute_top(list(range(900)), x, [i for i in range(900) if i % 50 == 0 or i == 5], 10)


def test_odd_search(spark):
    rows = [(0, [1.0, 2.0], 0, ""), (1, [1.0, 2.0], 0, ""), (2, None, 0, ""), (3, [float("nan")], 0, ""), (4, [1e30, 1e30], 0, ""), (5, [3.0], 0, ""), (None, [9.0, 9.0], 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in topk.search(df, df.where("vec_id IN (0, 2, 3)")).collect())
    assert got == [(0, 1, 4, 2**63 - 1), (0, 2, 1, 5 * 1024**2), (0, 3, 5, 3 * 1024**2)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
