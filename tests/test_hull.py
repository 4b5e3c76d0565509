"""Hulls against membership in the simplices of their points, in whole numbers."""

import itertools
import math

import numpy as np
import pytest

from lattica.inputs import voxels as image
from lattica.model import Scale
from lattica.operators import hull


def table(spark, places):
    return spark.createDataFrame([(*map(int, p), 1) for p in places], "z int, y int, x int, label long").repartition(4)


def det(rows):
    (a, b, c), (d, e, f), (g, h, i) = rows
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def in_tetrahedron(p, t):
    """Whether p lies in a tetrahedron that is not flat; None for a flat one."""
    whole = det([[x - y for x, y in zip(q, t[0])] for q in t[1:]])
    if not whole:
        return None
    signs = []
    for k in range(4):
        s = [p if i == k else q for i, q in enumerate(t)]
        signs.append(det([[x - y for x, y in zip(q, s[0])] for q in s[1:]]) * (1 if whole > 0 else -1))
    return all(s >= 0 for s in signs)


def by_simplices(points, box):
    """Places in some tetrahedron of the points: by Caratheodory's theorem all those in their hull, if the points span space."""
    tets = list(itertools.combinations(points, 4))
    return {p for p in box if any(in_tetrahedron(p, t) for t in tets)}


@pytest.mark.parametrize("seed", range(5))
def test_hulls_that_span_space(spark, seed):
    rng = np.random.default_rng(seed)
    points = sorted({tuple(map(int, p)) for p in rng.integers(0, 6, (8, 3))} | {(0, 0, 0), (5, 0, 0), (0, 5, 1), (1, 0, 5)})
    box = list(itertools.product(range(-1, 7), repeat=3))
    want = by_simplices(points, box)
    s = hull.half_spaces(np.array(points))
    assert {p for p in box if all(int(n[0]) * p[0] + int(n[1]) * p[1] + int(n[2]) * p[2] <= n[3] for n in s)} == want
    if seed < 2:
        assert {(r.z, r.y, r.x) for r in hull.filled(table(spark, points)).collect()} == want


@pytest.mark.parametrize("points,want", [
    ([(3, 4, 5)], {(3, 4, 5)}),
    ([(0, 0, 0), (6, 3, 9), (2, 1, 3)], {(0, 0, 0), (2, 1, 3), (4, 2, 6), (6, 3, 9)}),
    ([(0, 0, 0), (4, 4, 0), (0, 0, 4), (4, 4, 4), (2, 2, 2)], {(a, a, x) for a in range(5) for x in range(5)}),
    ([(2, 0, 0), (2, 4, 0), (2, 0, 4)], {(2, y, x) for y in range(5) for x in range(5) if y + x <= 4}),
    ([(0, 3, 3), (3, 0, 3), (3, 3, 0), (1, 2, 3)], {p for p in itertools.product(range(4), repeat=3) if sum(p) == 6}),
    ([], set()),
])
def test_flat_straight_and_single_sets(spark, points, want):
    assert {(r.z, r.y, r.x) for r in hull.filled(table(spark, points)).collect()} == want


def test_a_ball_is_its_own_hull_and_merges(spark, monkeypatch):
    ball = {p for p in itertools.product(range(-9, 10), repeat=3) if math.dist(p, (0, 0, 0)) <= 9}
    # of a shell only, from many tasks, in hulls of few corners each
    shell = {p for p in ball if math.dist(p, (0, 0, 0)) > 8}
    monkeypatch.setattr(hull, "AT_ONCE", 40)
    got = {(r.z, r.y, r.x) for r in hull.filled(table(spark, shell)).collect()}
    o = np.array(sorted(ball))
    n = hull.half_spaces(o)
    assert ball == got and ((o.astype(object) @ n[:, :3].T) <= n[:, 3]).all()


def test_wide_coordinates_are_exact():
    big = 1 << 40
    points = [(0, 0, 0), (big, 0, 0), (0, big, 0), (0, 0, big), (big // 3, big // 3, big // 3), (1, 1, 1)]
    n = hull.half_spaces(np.array(points))
    assert [tuple(map(int, r)) for r in n] == [(-1, 0, 0, 0), (0, -1, 0, 0), (0, 0, -1, 0), (1, 1, 1, big)]
    assert len(hull.corners(np.array(points))) == 4


def test_an_image_by_its_planes(spark):
    v = image(spark, "/root/testdata/sf0.001").where("label <= 3")
    at = np.array([(r.z, r.y, r.x) for r in v.collect()])
    got = {(r.z, r.y, r.x) for r in hull.filled(v).collect()}
    assert {tuple(p) for p in at} <= got
    # a place is outside if some direction tells it from all voxels; directions are those of random planes through three of them
    box = np.array(list(itertools.product(range(at[:, 0].min(), at[:, 0].max() + 1), range(60), range(60))))
    rng = np.random.default_rng(0)
    inside = np.ones(len(box), bool)
    for n in rng.standard_normal((4000, 3)):
        inside &= box @ n <= (at @ n).max() + 1e-9
    assert got <= {tuple(p) for p in box[inside]} and len(got) >= 0.97 * inside.sum()


def test_spans_are_greatest_distances(spark):
    rng = np.random.default_rng(6)
    own = {1: rng.integers(0, 9, (60, 3)), 2: np.array([[4, 4, 4]]), 3: np.array([[0, 0, 0], [0, 0, 7], [0, 0, 3]]), 4: np.array([[5, y, x] for y in range(6) for x in range(9)]), 5: rng.integers(-30, 30, (200, 3))}
    rows = [(*map(int, p), label) for label, at in own.items() for p in at]
    df = spark.createDataFrame(rows + rows[:5], "z int, y int, x int, label long").repartition(3)
    got = {r.label: r.span for r in hull.spans(df, Scale(1.0, 2.5)).collect()}
    for label, at in own.items():
        c = at * np.array([2.5, 1.0, 1.0])
        assert got[label] == pytest.approx(np.sqrt(((c[:, None] - c[None]) ** 2).sum(2).max()))
    assert hull.spans(df.where("false")).count() == 0
