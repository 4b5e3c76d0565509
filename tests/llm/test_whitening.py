"""Whitening against numpy's own eigenvectors and exact integers, on tables with hot copies, gaps, odd lengths and flat dimensions."""

import numpy as np
import pytest

from lattica.llm import queries, whitening


def plain(vectors):
    """(n, S, covariance, whole numbers of each row or None), with Python integers."""
    xs = []
    for v in vectors:
        fine = v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)
        xs.append(tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) if fine else None)
    sizes = [len(x) for x in set(xs) - {None}]
    d = max(sizes, key=lambda s: (sizes.count(s), s))
    xs = [x if x and len(x) == d else None for x in xs]
    own = sorted(set(xs) - {None})
    n, s = len(own), [sum(c) for c in zip(*own)]
    m = np.array([[float(n * c - t) for c, t in zip(x, s)] for x in own]) / n
    return n, s, m.T @ m / n, xs


def same_up_to_sign(got, want):
    return np.abs(got - np.sign((got * want).sum()) * want).max()


@pytest.mark.parametrize("seed,d", [(1, 1), (2, 2), (3, 7), (4, 40), (5, 128)])
def test_components_are_eigenvectors(seed, d):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((3 * d + 1, d)) * np.exp(rng.uniform(-4, 4, d))
    v = a.T @ a / len(a)
    e, w = whitening.components_of(v)
    want, vectors = np.linalg.eigh(v)
    assert np.allclose(e, want[::-1], rtol=1e-9, atol=1e-13 * want[-1])
    assert np.abs(w.T @ w - np.eye(d)).max() < 1e-12 and np.abs(v @ w - w * e).max() < 1e-12 * want[-1]
    gap = np.diff(want).min() if d > 1 else 1.0
    assert all(same_up_to_sign(w[:, i], vectors[:, d - 1 - i]) < 1e-11 * want[-1] / gap + 1e-12 for i in range(d))


def test_components_of_repeated_and_missing_values():
    rng = np.random.default_rng(7)
    q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    for values in ([3.0] * 12, [5.0] * 4 + [1.0] * 4 + [0.0] * 4, [1.0] + [0.0] * 11, [0.0] * 12, [2.0] * 11 + [1.0], [1e8, 1e4, 1, 1e-4] * 3):
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        e, w = whitening.components_of(v)
        assert np.allclose(e, sorted(values, reverse=True), atol=1e-13 * max(values)) and np.abs(w.T @ w - np.eye(12)).max() < 1e-12
        assert np.abs(v @ w - w * e).max() <= 1e-12 * max(values)
    e, w = whitening.components_of(np.diag([1.0, 3.0, 2.0]))
    assert e.tolist() == [3, 2, 1]


def test_polar_factor():
    a = np.diag([3.0, -2.0, 1e-9, -1e-12])
    assert np.allclose(whitening.polar(a), np.diag([1.0, -1.0, 1.0, -1.0]), atol=1e-10)


def check(rows, ids, vectors, most=16):
    n, s, v, xs = plain(vectors)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    k = min(most, int((e > len(e) * np.finfo(float).eps * e[0]).sum()))
    usable = [(i, x) for i, x in zip(ids, xs) if x]
    assert len(rows) == k * len(usable) and {r.component for r in rows} == set(range(1, k + 1))
    away = {}
    for i, x in usable:
        away.setdefault(i, []).append((sum((n * c - t) ** 2 for c, t in zip(x, s)), (np.array([float(n * c - t) for c, t in zip(x, s)]) / n) @ w[:, :k] / np.sqrt(e[:k])))
    for c in range(1, k + 1):
        mine = [r for r in rows if r.component == c]
        assert all(r.n == n and abs(r.explained / (e[c - 1] / np.trace(v)) - 1) < 1e-9 and r.identity_error < 1e-9 for r in mine)
        got, want = [], []
        for i in sorted(away, key=str):
            got += sorted((int(r.deviation), abs(r.whitened)) for r in mine if r.vec_id == i)
            want += sorted((a, abs(p[c - 1])) for a, p in away[i])
        assert [g for g, _ in got] == [g for g, _ in want]
        assert np.allclose([g for _, g in got], [g for _, g in want], atol=1e-7)
    for i in range(1, k + 1):
        signs = {np.sign(r.whitened * away[r.vec_id][0][1][i - 1]) for r in rows if r.component == i and len(away[r.vec_id]) == 1 and abs(r.whitened) > 1e-6}
        assert len(signs) <= 1


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(1)
    many = [list(map(float, v)) for v in rng.standard_normal((90, 6)).astype(np.float32) * [1, 2, 3, 4, 0, 1000]]
    many += [many[0]] * 200 + [None, [], [1.0] * 5, [None, 1.0, 2.0, 3.0, 4.0, 5.0], [float("nan")] * 6, [float("inf"), *[0.0] * 5], [1e30] + [0.0] * 5]
    return [None if i == 3 else 5 if i == 4 else i for i in range(len(many))], many


def test_whitening_of_odd_vectors(spark, odd):
    ids, many = odd
    rows = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in zip(ids, many)], "vec_id long, embedding array<float>, n int, whitened string, key double").repartition(3)
    check(whitening.whiten(rows).collect(), ids, many[:-1] + [None])
    few = whitening.whiten(rows, most=2)
    assert {r.component for r in few.select("component").distinct().collect()} == {1, 2}
    for none in (rows.where("false"), rows.where("vec_id = 0"), rows.where("size(embedding) = 0 OR embedding IS NULL")):
        got = whitening.whiten(none)
        assert got.count() == 0 and got.columns == few.columns


def test_large_deviations_are_exact(spark):
    many = [[float(1 << 33), -float(1 << 33)], [0.0, 0.5], [-float(1 << 32), 3.0], [7.0, float(1 << 20)]]
    rows = spark.createDataFrame(list(enumerate(many)), "vec_id long, embedding array<float>")
    check(whitening.whiten(rows).collect(), range(4), many)


def test_query_over_the_whole_table(spark):
    table = queries.table(spark, "/root/testdata/sf0.01", "embeddings").collect()
    check(queries.op11_whitening(spark, "/root/testdata/sf0.01").collect(), [r.vec_id for r in table], [r.embedding for r in table])
