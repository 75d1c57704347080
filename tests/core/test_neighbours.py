"""Neighbour joins against brute force, and how much of the work bounds save."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import clustering, graph, maintenance, neighbours
from mnemospark.sources import tables


def frame(spark, m, ids=None):
    return spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(range(len(m)) if ids is None else ids, m)], "id long, vector array<double>")


def scores(m, cosine):
    if cosine:
        n = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        return -(n @ n.T)
    return ((m[:, None] - m[None]) ** 2).sum(axis=2)


def data(kind, n=400, dim=6):
    rng = np.random.default_rng(len(kind))
    if kind == "even":
        return rng.normal(size=(n, dim))
    if kind == "clustered":
        return rng.normal(size=(8, dim))[rng.integers(0, 8, n)] * 20 + rng.normal(size=(n, dim)) * 0.1
    if kind == "copies":
        m = rng.integers(-1, 2, size=(n, dim)).astype(float)
        m[: n // 2] = m[0]
        return m
    m = rng.normal(size=(n, dim))
    m[:20] = 0
    return m


@pytest.mark.parametrize("kind", ["even", "clustered", "copies", "zeros"])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_k_nearest(spark, kind, metric):
    m = data(kind)
    s = np.round(scores(m, metric == "cosine"), 9)
    np.fill_diagonal(s, np.inf)
    for block in (32, 1000):
        got = {}
        for r in neighbours.neighbours(frame(spark, m), 6, 5, metric=metric, block=block).collect():
            got.setdefault(r.src, []).append((r["rank"], r.dst, round(-r.score if metric == "cosine" else r.score, 9)))
        for i in range(len(m)):
            mine = sorted(got[i])
            assert [x[0] for x in mine] == [1, 2, 3, 4, 5]
            want = sorted((v, j) for j, v in enumerate(s[i]))[:5]
            assert np.allclose([x[2] for x in mine], [v for v, _ in want], atol=2e-9)
            if kind in ("even", "clustered"):
                assert [x[1] for x in mine] == [j for _, j in want]


@pytest.mark.parametrize("kind", ["even", "clustered", "copies", "zeros"])
@pytest.mark.parametrize("metric,radius", [("l2", 2.000001), ("cosine", 0.7000001), ("cosine", -0.1000001)])
def test_within_radius(spark, kind, metric, radius):
    m = data(kind)
    s = scores(m, metric == "cosine")
    np.fill_diagonal(s, np.inf)
    x, y = np.nonzero(s <= (-radius if metric == "cosine" else radius))
    for block in (32, 1000):
        got = neighbours.neighbours(frame(spark, m), 6, radius=radius, metric=metric, block=block).collect()
        assert len(got) == len(x) and {(r.src, r.dst) for r in got} == set(zip(x.tolist(), y.tolist()))


def test_odd_rows(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.5]), (2, [0.0, 1.5]), (None, [0.0, 1.0]), (3, None), (4, [1.0]), (-(1 << 62), [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").selectExpr("*", "1 as place", "2 as V", "3 as reach")
    got = neighbours.neighbours(df, 2, 2, metric="l2").collect()
    assert {(r.src, r.dst) for r in got} == {(1, 2), (2, 1), (2, -(1 << 62)), (-(1 << 62), 2)}
    for k, radius in ((2, None), (None, 1.0)):
        assert neighbours.neighbours(df.limit(0), 2, k, radius, "l2").collect() == []
        assert neighbours.neighbours(df.limit(0), 2, k, radius, "l2", block=1).collect() == []


def test_bounds_skip_most_of_clustered_data(spark):
    """Fewer than half of the pairs of blocks are visited, and no bound is above a true distance."""
    m = data("clustered", 2000)
    rows = frame(spark, m).select("id", F.col("vector").alias("v"))
    out, blocks = neighbours.placed(rows, 6, len(m), 64)
    of = {r.id: r.place for r in out.collect()}
    n = len(blocks.cell)
    place = np.array([of[i] for i in range(len(m))])
    far = np.sqrt(scores(m, False))
    d = blocks.distances(m)
    pairs = 0
    for i in range(n):
        between = blocks.between(i)
        for j in range(n):
            cell = far[np.ix_(place == i, place == j)]
            if cell.size:
                assert between[j] <= cell.min() + 1e-9
                assert (blocks.bound(d[place == i], np.array([j]))[:, 0] <= cell.min(axis=1) + 1e-9).all()
        pairs += int((between <= 1.0).sum())
    assert pairs < n * n / 4 and np.bincount(place).max() <= 200


def test_link_threshold_is_asked_before_rounding(spark):
    c = (0.4003 - 0.15) / 0.85  # a weight of 0.4003, which rounds to 0.4
    df = spark.createDataFrame([(0, [1.0, 0.0], 0.0, "a"), (1, [c, (1 - c * c) ** 0.5], 0.0, "b")], "id long, vector array<double>, timestamp double, source_file string")
    assert sorted(map(tuple, graph.link_neighbors(df, 2, denoised=False).collect())) == [(0, 1, 0.4), (1, 0, 0.4)]


def test_cluster_memories_is_brute_force(spark):
    """Denoised vectors, the radius from as many neighbours as a core needs, clusters by density, small ones merged."""
    rng = np.random.default_rng(11)
    n, dim = 120, 8
    m = rng.normal(size=(6, dim))[rng.integers(0, 6, n)] * 3 + rng.normal(size=(n, dim)) * 0.4
    got = {r.id: r.label for r in clustering.cluster_memories(frame(spark, m), dim).collect()}
    x = m - m.mean(axis=0)
    basis = np.linalg.svd(x, full_matrices=False)[2]
    x = x - x @ basis[:3].T @ basis[:3]
    x = (x @ basis[3:].T)[:, :50]
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    far = np.sqrt(scores(x, False))
    np.fill_diagonal(far, np.inf)
    least = max(2, min(8, n // 20))
    eps = np.sort(far, axis=1)[:, :least].mean()
    core = (far <= eps).sum(axis=1) + 1 >= least
    label = np.full(n, -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], label.max() + 1
            while todo:
                a = todo.pop()
                for b in np.flatnonzero((far[a] <= eps) & core & (label < 0)):
                    label[b] = label[i]
                    todo.append(b)
    out = label.copy()
    for i in np.flatnonzero(~core):
        near = np.flatnonzero((far[i] <= eps) & core)
        out[i] = label[near[0]] if len(near) else -1
    size = {c: (out == c).sum() for c in set(out.tolist()) - {-1}}
    assert len(size) > 1 and -1 in out
    big = [c for c in size if size[c] >= 6]
    mean = {c: x[out == c].mean(axis=0) for c in size}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    final = [-1 if c < 0 or not big else c if size[c] >= 6 else max(big, key=lambda t: (round(cos(mean[c], mean[t]), 9), -t)) for c in out.tolist()]
    assert [got[i] for i in range(n)] == final


def test_greedy_duplicates_over_blocks(spark, monkeypatch):
    m = data("clustered", 300)
    near = scores(m, False)
    kept, want = [], {}
    for i in range(len(m)):
        close = [j for j in kept if near[i, j] < 0.12]
        want[i] = (not close, min(close, key=lambda j: (near[i, j], j)) if close else None)
        kept += [] if close else [i]
    assert 20 < len(kept) < 280
    whole = neighbours.neighbours
    for block in (32, 4096):
        monkeypatch.setattr(maintenance, "neighbours", lambda *a, block=block, **k: whole(*a, block=block, **k))
        assert {r.id: (r.kept, r.duplicate_of) for r in maintenance.semantic_dedup(frame(spark, m), 6, 0.12).collect()} == want


def greedy(m, limit):
    near, kept, want = scores(m, False), [], {}
    for i in range(len(m)):
        close = [j for j in kept if near[i, j] < limit]
        want[i] = (not close, min(close, key=lambda j: (near[i, j], j)) if close else None)
        kept += [] if close else [i]
    return want


@pytest.mark.parametrize("kind,limit", [("even", 2.0), ("even", 6.0), ("clustered", 0.12), ("copies", 2.5), ("copies", 4.5), ("zeros", 3.0), ("mixed", 3.0)])
@pytest.mark.parametrize("held", [1 << 23, 600])
def test_greedy_duplicates_by_passes_and_pairs(spark, monkeypatch, kind, limit, held):
    """Passes alone, pairs after passes, and rows of passes that are nearest to a row kept by pairs, in several parts."""
    m = data(kind)
    if kind == "mixed":  # the first pass settles a half; of those rows some have what is kept later for their nearest
        m[:200:2] = m[0] + np.random.default_rng(1).normal(size=(100, 6)) * 0.4
        m[200:] = m[200:] * 2
        m[300:340] = m[0] + np.random.default_rng(2).normal(size=(40, 6)) * 0.8
    whole, calls, parts = neighbours.neighbours, [], []
    monkeypatch.setattr(maintenance, "neighbours", lambda *a, **k: calls.append(1) or whole(*a, block=32, **k))
    nearer = maintenance._nearer
    monkeypatch.setattr(maintenance, "_nearer", lambda *a: parts.append(1) or nearer(*a))
    monkeypatch.setattr(maintenance, "PREFIX", 32)
    monkeypatch.setattr(maintenance, "HELD", held)
    assert {r.id: (r.kept, r.duplicate_of) for r in maintenance.semantic_dedup(frame(spark, m), 6, limit).collect()} == greedy(m, limit)
    assert len(calls) == len(parts) and {("even", 2.0): len(calls) == 1, ("even", 6.0): not calls}.get((kind, limit), True)


def test_rows_kept_late_may_be_nearest(spark, monkeypatch):
    """A row that a pass settles has its nearest among rows kept by pairs; what is within half the limit's root is not asked."""
    monkeypatch.setattr(maintenance, "PREFIX", 1)
    monkeypatch.setattr(maintenance, "HELD", 4)
    m = np.array([[0.0, 0], [5.0, 0], [6.1, 0], [0.9, 0], [5.55, 0], [5.2, 0], [5.8, 0], [9.0, 0]])
    assert {r.id: (r.kept, r.duplicate_of) for r in maintenance.semantic_dedup(frame(spark, m), 2, 1.0).collect()} == greedy(m, 1.0)


def test_many_close_pairs_are_not_written(spark):
    """Greedy duplicates of 6000 rows, a third of them copies: what is written is some times the table, not its close pairs."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(6000, 6))
    m[::3] = m[0]
    df = frame(spark, m)
    first = len(tables.MADE)
    got = {r.id: (r.kept, r.duplicate_of) for r in maintenance.semantic_dedup(df, 6, 4.0).collect()}
    made = sum(os.path.getsize(os.path.join(d, f)) for top in tables.MADE[first:] for d, _, names in os.walk(top.removeprefix("file://")) for f in names)
    assert made < 4 * m.nbytes
    kept = [i for i in range(len(m)) if got[i][0]]
    assert 20 < len(kept) < 3000 and got[3] == (False, 0) and {i: v for i, v in got.items() if i < 500} == greedy(m[:500], 4.0)


def test_greedy_duplicates_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(maintenance, "PREFIX", 2)
    rows = [(1, [0.0, 1.0]), (None, [0.0, 1.0]), (3, None), (4, [1.0]), (-5, [0.0, 1.1]), (6, [float("nan"), 1.0]), (7, [0.1, 1.0]), (8, [0.0, 1.04])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = sorted(map(tuple, maintenance.semantic_dedup(df, 2, 0.05).collect()), key=str)
    assert got == sorted([(-5, True, None), (1, False, -5), (None, True, None), (3, True, None), (4, True, None), (6, True, None), (7, False, -5), (8, False, -5)], key=str)
    assert all(r.kept for r in maintenance.semantic_dedup(df, 2, 0.0).collect())
    assert maintenance.semantic_dedup(df.limit(0), 2).collect() == []
    twice = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.1]), (2, [9.0, 1.0]), (3, [9.0, 1.1])], "id long, vector array<double>")
    assert sorted(map(tuple, maintenance.semantic_dedup(twice, 2, 0.05).collect())) == [(1, True, None), (2, False, 1), (2, False, 1), (3, True, None)]


def test_small_clusters_merge_over_blocks(spark):
    rng = np.random.default_rng(5)
    label = [k for k in range(40) for _ in range(3 if k % 2 else 8)] + [-1] * 5
    m = rng.normal(size=(40, 4))[label] + rng.normal(size=(len(label), 4)) * 0.1
    m[[i for i, c in enumerate(label) if c == 4]] = m[[i for i, c in enumerate(label) if c == 2]]
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(m, label))], "id long, vector array<double>, label int")
    mean = {c: m[np.array(label) == c].mean(axis=0) for c in range(40)}
    cos = lambda a, b: round(a @ b / np.sqrt((a @ a) * (b @ b)), 9)
    to = {c: max((b for b in range(0, 40, 2)), key=lambda b: (cos(mean[c], mean[b]), -b)) for c in range(1, 40, 2)}
    want = {i: to.get(c, c) for i, c in enumerate(label)}
    for block in (3, 4096):
        assert {r.id: r.label for r in clustering.merge_tiny(df, 4, 6, block).collect()} == want
    assert {r.label for r in clustering.merge_tiny(df, 4, 100).collect()} == {-1} and clustering.merge_tiny(df.limit(0), 4).collect() == []


def test_rows_go_once_to_a_group_of_blocks(spark):
    """Groups hold neighbouring blocks up to a number of rows, and a row is sent to a group, not to its blocks."""
    m = data("even", 2000)
    out, blocks = neighbours.placed(frame(spark, m).select("id", F.col("vector").alias("v")), 6, len(m), 32)
    n, groups = len(blocks.cell), blocks.group.max() + 1
    rows = np.bincount([r.place for r in out.collect()], minlength=n)
    assert n > 60 and groups <= n / 3
    assert len(set(zip(blocks.group.tolist(), blocks.slot.tolist()))) == n and blocks.slot.max() < 62
    assert np.bincount(blocks.group, rows).max() <= 2 * 32 * neighbours.GROUP
    x, group, bits = blocks.calls(np.ones((3, n), bool), np.arange(n))
    assert len(x) == 3 * groups and sum(int(b).bit_count() for b in bits.tolist()) == 3 * n
