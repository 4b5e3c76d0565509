"""Nearest features and depths against a look at every pair."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.inputs import voxels as image
from lattica.model import Scale
from lattica.operators import distance as D
from lattica.operators import voxels as V


def table(spark, rows):
    return spark.createDataFrame([(*map(int, p), int(l)) for p, l in rows], "z int, y int, x int, label long").repartition(5)


def brute(rows, radius, shape, scale):
    """The least (d2, label) of every place within the radius, in the order of sums that a table of pairs has."""
    at, label = np.array([p for p, _ in rows]).reshape(-1, 3), np.array([l for _, l in rows])
    out = {}
    for p in itertools.product(*map(range, shape)):
        d2 = ((at[:, 0] - p[0]) * scale.z) ** 2 + ((at[:, 1] - p[1]) * scale.xy) ** 2 + ((at[:, 2] - p[2]) * scale.xy) ** 2
        if len(d2) and d2.min() <= radius * radius:
            out[p] = (d2.min(), label[d2 == d2.min()].min())
    return out


@pytest.mark.parametrize("radius,scale,shape,n", [(0.0, Scale(), (4, 5, 6), 9), (2.0, Scale(), (5, 9, 8), 12), (30.0, Scale(), (7, 11, 40), 6), (4.5, Scale(1.0, 2.5), (6, 9, 12), 10), (5.0, Scale(1.5, 1.0), (1, 20, 25), 9), (3.0, Scale(), (1, 1, 30), 3)])
def test_nearest(spark, radius, scale, shape, n):
    rng = np.random.default_rng(n)
    rows = [(tuple(rng.integers(0, shape)), rng.integers(1, 5)) for _ in range(n)]
    rows += rows[:2]
    got = {(r.z, r.y, r.x): (r.d2, r.label) for r in D.nearest(table(spark, rows), radius, shape, scale).collect()}
    assert got == brute(rows, radius, shape, scale)
    each = {(r.z, r.y, r.x, r.label): r.d2 for r in D.nearest(table(spark, rows), radius, shape, scale, each=True).collect()}
    want = {(*p, l): d for l in {l for _, l in rows} for p, (d, _) in brute([r for r in rows if r[1] == l], radius, shape, scale).items()}
    assert each == want


def test_nearest_of_odd_tables(spark):
    beyond = [((-2, 3, 3), 4), ((9, 1, 1), 2), ((2, 2, 2), 3)]
    got = {(r.z, r.y, r.x): (r.d2, r.label) for r in D.nearest(table(spark, beyond), 3.0, (5, 6, 7)).collect()}
    assert got == brute(beyond, 3.0, (5, 6, 7), Scale())
    none = table(spark, beyond).where("false")
    assert D.nearest(none, 3.0, (5, 6, 7)).count() == 0 and D.squared_depths(none).count() == 0


def test_ties_go_to_the_smaller_label_wherever_it_stands():
    """Three parabolas meet in a place, and the middle one, which is nowhere below the others, has the least label."""
    at, cost, label = np.array([0, 2, 4]), np.array([0.0, 4.0, 0.0]), np.array([7, 1, 9])
    d2, name = D.least_on_lines(np.zeros(3, int), at, cost, label, np.zeros(5, int), np.arange(5), 1.0)
    assert d2.tolist() == [0, 1, 4, 1, 0] and name.tolist() == [7, 7, 1, 9, 9]


def test_lines_of_any_length(spark):
    """Lines longer than a batch, and batches of many lines, are cut at lines only."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [((z, 3, x), 1 + x % 3) for z in (0, 1) for x in range(0, 60, 2)]
        got = {(r.z, r.y, r.x): (r.d2, r.label) for r in D.nearest(table(spark, rows), 2.0, (3, 6, 60)).collect()}
        assert got == brute(rows, 2.0, (3, 6, 60), Scale())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_far_reaches_over_a_whole_image(spark):
    v = image(spark, "/root/testdata/sf0.001")
    rows = [((r.z, r.y, r.x), r.label) for r in v.collect()]
    at, label = np.array([p for p, _ in rows]), np.array([l for _, l in rows])
    few = v.where("label <= 2")
    sparse = [r for r in rows if r[1] <= 2]
    for radius in (9.5, 30.0):
        got = V.dilate_labels(few, radius, (24, 60, 60)).collect()
        a, l = np.array([p for p, _ in sparse]), np.array([l for _, l in sparse])
        want = {}
        for z in range(24):
            places = np.array(list(itertools.product([z], range(60), range(60))))
            d2 = ((places[:, None] - a[None]) ** 2).sum(2)
            best = d2.min(1)
            name = np.where(d2 == best[:, None], l[None], 99).min(1)
            want |= {tuple(p): n for p, n, d in zip(places.tolist(), name, best) if d <= radius * radius}
        assert {(r.z, r.y, r.x): r.label for r in got} == want
        assert V.dilate(few, radius, (24, 60, 60)).count() == len(want)
    deep = {(r.z, r.y, r.x): r.d2 for r in D.squared_depths(V.dilate_labels(v, 3.0, (24, 60, 60))).collect()}
    assert len(deep) > len(at) and label.max() <= 40 and max(deep.values()) > 1


def test_erosion_of_thick_bodies(spark):
    body = set(itertools.product(range(3, 18), range(2, 20), range(4, 30))) - {(10, 10, 10)}
    rows = [(p, 1 if p[2] < 17 else 2) for p in body]
    outside = [p for p in itertools.product(range(2, 19), range(1, 21), range(3, 31)) if p not in body]
    o = np.array(outside)
    far = {p for p in body if ((o - p) ** 2).sum(1).min() > 16}
    assert {(r.z, r.y, r.x) for r in V.erode(table(spark, rows), 4.0).collect()} == far
    keep = set()
    for p, l in rows:
        others = np.array([q for q, m in rows if m != l and q[0] == p[0] and q[1] == p[1]])
        if p in far and ((others - p) ** 2).sum(1).min() > 16:
            keep.add((p, l))
    assert {((r.z, r.y, r.x), r.label) for r in V.erode(table(spark, rows), 4.0, keep_labels=True).collect()} == keep
    assert V.erode(table(spark, rows).withColumn("more", F.lit(1)), 4.0).columns == ["z", "y", "x", "label", "more"]


def test_radius_of_a_ball(spark):
    ball = {p for p in itertools.product(range(21), repeat=3) if math.dist(p, (10, 10, 10)) <= 8}
    rows = [(p, 5) for p in ball] + [((30, 30, 30), 6)]
    found = {r.id: r.radius for r in V.radii(table(spark, rows), Scale(2.0, 2.0)).collect()}
    o = np.array([p for p in itertools.product(range(21), repeat=3) if p not in ball])
    assert found == {5: pytest.approx(2 * math.sqrt(((o - 10) ** 2).sum(1).min())), 6: 2.0}
