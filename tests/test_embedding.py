"""The map of neighbours: recall of the neighbours against all pairs, likeness against bisection by hand, and what the map keeps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import embedding as M

SF = "/root/testdata/sf0.001"


def nearest(v, k):
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, 1, kind="stable")[:, :k]


def kept(x, true):
    near = nearest(x, true.shape[1])
    return np.mean([len(set(a) & set(b)) / len(a) for a, b in zip(near, true)])


def test_few_points_have_exact_neighbours_and_likeness(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((40, 3))
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i long, v array<double>").repartition(3)
    near = M.nearest_vectors(points, 6)
    rows = near.collect()
    assert {(r.i, r.j) for r in rows} == {(i, int(j)) for i, n in enumerate(nearest(v, 6)) for j in n}
    assert all(r.d == pytest.approx(math.dist(v[r.i], v[r.j])) for r in rows)
    own = {}
    for r in rows:
        own.setdefault(r.i, {})[r.j] = r.d
    p = {}
    for i, d in own.items():
        lo, hi = 0.0, 1e4
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if sum(math.exp(-(x - min(d.values())) / mid) for x in d.values()) > math.log2(6) else (mid, hi)
        p |= {(i, j): math.exp(-(x - min(d.values())) / lo) for j, x in d.items()}
    want = {e: 1 - (1 - p.get(e, 0)) * (1 - p.get(e[::-1], 0)) for e in p} | {e[::-1]: 1 - (1 - p.get(e, 0)) * (1 - p.get(e[::-1], 0)) for e in p}
    got = {(r.i, r.j): r.w for r in M.fuzzy_graph(near, 6).collect()}
    assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e], abs=1e-6) for e in want)


def test_the_map_keeps_neighbours_better_than_components(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id")
    v = np.array([r[0] for r in e.select("embedding").collect()], float)
    v = np.unique(v, axis=0)
    true = nearest(v, 15)
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i long, v array<double>")
    found = {}
    for r in M.nearest_vectors(points, 15, projections=6).collect():
        found.setdefault(r.i, set()).add(r.j)
    assert all(len(f) == 15 for f in found.values()) and np.mean([len(found[i] & set(map(int, n))) / 15 for i, n in enumerate(true)]) > 0.9
    c = v - v.mean(0)
    flat = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    df = spark.createDataFrame([(i, *x.tolist()) for i, x in enumerate(v)], ["i", *(f"f{c}" for c in range(v.shape[1]))])
    x = np.array([r[0] for r in M.embed(df, df.columns[1:], rounds=5).orderBy("i").select("embedding").collect()])
    assert kept(x, true) > 1.5 * kept(flat, true)


def test_reruns_agree_and_odd_tables(spark):
    rows = [(i, float(i % 7), float((i * i) % 11), None if i % 5 == 0 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:20], "id long, a double, b double, c double").repartition(4)
    once, again = ({(r.id, *r.embedding) for r in M.embed(df, ["a", "b", "c"], rounds=2).collect()} for _ in range(2))
    assert once == again and len({r[0] for r in once}) == 60 == len(once)
    assert len({r[1:] for r in once}) == len({(a, b, c or 0) for _, a, b, c in rows})
    for few, n in ((df.where("false"), 0), (df.where("id = 3"), 2), (df.where("id IN (3, 4)"), 4)):
        got = M.embed(few, ["a", "b", "c"])
        assert got.count() == n and got.columns == [*df.columns, "embedding"]


def test_points_are_not_broadcast(spark):
    rows = spark.range(50).select("id", F.col("id").cast("double").alias("a"), F.pmod("id", F.lit(7)).cast("double").alias("b"))
    near = spark.range(50).select(F.col("id").alias("i"), F.pmod(F.col("id") + 1, F.lit(50)).alias("j"), F.lit(1.0).alias("d"))
    for df in (M.embed(rows, ["a", "b"], rounds=1), M.fuzzy_graph(near, 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
