"""Density clusters against a plain version with all pairs, on clouds, chains, repeated places and places at exactly the radius."""

import numpy as np
import pytest

from lattica.operators import cluster as K


def plain(points, eps, least):
    ids, at = [p[0] for p in points], np.array([p[1:] for p in points], float).reshape(len(points), -1)
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    near = d2 <= eps * eps
    core = near.sum(1) >= least
    root = {i: i for i in range(len(ids)) if core[i]}
    for i in sorted(root, key=lambda i: ids[i]):
        todo = [i]
        while todo:
            a = todo.pop()
            for b in np.flatnonzero(near[a] & core):
                if ids[root[b]] > ids[root[a]]:
                    root[b] = root[a]
                    todo.append(b)
    names = {r: n + 1 for n, r in enumerate(sorted(set(root.values()), key=lambda i: ids[i]))}
    out = {}
    for i, k in enumerate(ids):
        best = min(((d2[i, j], ids[j], j) for j in np.flatnonzero(near[i] & core)), default=None)
        out[k] = names[root[best[2]]] if best else 0
    return out


@pytest.mark.parametrize("seed,eps,least,axes", [(1, 3.0, 4, "zyx"), (2, 5.0, 3, "zyx"), (3, 2.0, 5, "yx"), (4, 1.0, 2, "zyx")])
def test_clusters(spark, monkeypatch, seed, eps, least, axes):
    monkeypatch.setattr(K, "CHUNK", 5)
    rng = np.random.default_rng(seed)
    at = np.concatenate([rng.integers(0, 30, (150, 3)), rng.normal(8, 1.5, (60, 3)).round().astype(int), [[40, 3 * i, 0] for i in range(12)], [[-9, -9, -9]] * 30, [[-9, -9, -7]]])
    at[:, 0] *= "z" in axes
    rows = [(int(i), *map(int, p)) for i, p in zip(rng.permutation(len(at)), at)]
    df = spark.createDataFrame(rows, "id long, z int, y int, x int").repartition(3)
    got = {r.id: r.cluster for r in K.dbscan(df, eps, least, tuple(axes)).collect()}
    want = plain([(r[0], *(r[1 + "zyx".index(a)] for a in axes)) for r in rows], eps, least)
    assert got == want and len(set(want.values())) > 2


def test_no_points_and_no_cores(spark):
    df = spark.createDataFrame([(1, 0, 0, 0), (2, 9, 9, 9)], "id long, z int, y int, x int")
    assert {(r.id, r.cluster) for r in K.dbscan(df, 2.0, 2).collect()} == {(1, 0), (2, 0)}
    assert K.dbscan(df.where("false"), 2.0, 2).count() == 0
