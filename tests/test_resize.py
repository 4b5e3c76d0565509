"""Cubic splines against a dense solve of the whole system and against curves that splines reproduce."""

import itertools

import numpy as np
import pytest

from lattica.operators import resize


def basis(size):
    """Values of the mirrored B-splines at the places: the system that coefficients solve."""
    m = np.zeros((size, size))
    for i in range(size):
        for d, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            j = abs(i + d)
            m[i, 2 * (size - 1) - j if j > size - 1 else j if size > 1 else 0] += w
    return m


def spline(line, new):
    """The mirrored spline through a line, one point at a time."""
    n = len(line)
    c = np.linalg.solve(basis(n), line) if n > 1 else np.array(line, float)
    b = lambda t: (2 / 3 - t * t + abs(t) ** 3 / 2) if abs(t) < 1 else (2 - abs(t)) ** 3 / 6 if abs(t) < 2 else 0.0
    out = []
    for i in range(new):
        x = i * (n - 1) / (new - 1) if new > 1 else 0.0
        far = range(int(x) - 2, int(x) + 4)
        mirror = lambda j: 0 if n == 1 else (lambda k: 2 * (n - 1) - k if k > n - 1 else k)(abs(j) % (2 * (n - 1)))
        out.append(sum(c[mirror(j)] * b(x - j) for j in far))
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 5, 40])
def test_splines_pass_through_their_values(size):
    lines = np.random.default_rng(size).standard_normal((3, size))
    c = resize.coefficients(lines)
    if size > 1:
        assert np.allclose(c @ basis(size).T, lines, atol=1e-12)
    place, weight = resize.taps(size, size)
    assert np.allclose((c[:, place] * weight).sum(2), lines, atol=1e-12)


@pytest.mark.parametrize("factors", [(2, 0.5, 1.5), (0.4, 1, 3), (0.1, 1.7, 0.2), (1, 1, 1)])
def test_resized_image(spark, factors):
    rng = np.random.default_rng(2)
    shape = (6, 9, 7)
    dense = np.where(rng.random(shape) < 0.4, rng.standard_normal(shape), 0.0)
    rows = [(*p, float(dense[p])) for p in itertools.product(*map(range, shape)) if dense[p]]
    image = spark.createDataFrame(rows, "z int, y int, x int, value double").repartition(5)
    want = dense
    for axis, (n, f) in enumerate(zip(shape, factors)):
        if f != 1:
            want = np.apply_along_axis(spline, axis, want, max(1, round(n * f)))
    got = {(r.z, r.y, r.x): r.value for r in resize.resized(image, shape, factors).collect()}
    if factors != (1, 1, 1):
        assert set(got) == set(itertools.product(*map(range, want.shape)))
    assert all(abs(v - want[p]) < 1e-9 for p, v in got.items())
    assert resize.resized(image.where("false"), shape, factors).count() == 0


def test_many_lines_in_little_memory(spark, monkeypatch):
    monkeypatch.setattr(resize, "AT_ONCE", 50)
    rows = [(z, y, x, float(x * x)) for z in range(4) for y in range(5) for x in range(11)]
    image = spark.createDataFrame(rows, "z int, y int, x int, value double")
    got = {(r.z, r.y, r.x): r.value for r in resize.resized(image, (4, 5, 11), (1, 1, 2)).collect()}
    want = spline([x * x for x in range(11)], 22)
    assert len(got) == 4 * 5 * 22 and all(abs(v - want[x]) < 1e-9 for (_, _, x), v in got.items())
