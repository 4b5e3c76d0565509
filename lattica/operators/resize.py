"""Resizing of images by cubic splines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distance import AT, Columns, by_lines

#: Places of dense lines that are in memory at a time.
AT_ONCE = 1 << 20


def coefficients(lines: np.ndarray) -> np.ndarray:
    """B-spline coefficients of lines (rows of a matrix) that are mirrored at their first and last place: the splines pass through all values. A
    tridiagonal system, solved for all lines side by side."""
    n = lines.shape[1]
    if n == 1:
        return lines.astype(float)
    upper, out = np.empty(n), np.empty(lines.shape)
    # the mirrored neighbour of the first place is its second one, so that it counts twice there; likewise at the end
    upper[0], out[:, 0] = 2 / 4, 6 * lines[:, 0] / 4
    for i in range(1, n):
        low = 2 if i == n - 1 else 1
        pivot = 4 - low * upper[i - 1]
        upper[i] = 1 / pivot
        out[:, i] = (6 * lines[:, i] - low * out[:, i - 1]) / pivot
    for i in range(n - 2, -1, -1):
        out[:, i] -= upper[i] * out[:, i + 1]
    return out


def taps(size: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights), four for each new place: ends stay on ends, new places are spread evenly between them."""
    at = np.arange(new) * ((size - 1) / (new - 1) if new > 1 else 1.0)
    first = np.floor(at).astype(np.int64)
    t = at - first
    weights = np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, 3 * (1 - t) ** 3 - 6 * (1 - t) ** 2 + 4, t**3], 1) / 6
    place = first[:, None] + np.arange(-1, 3)
    turn = max(1, 2 * (size - 1))
    place = np.abs(place) % turn
    return np.where(place > size - 1, turn - place, place) if size > 1 else np.zeros_like(place), weights


def resized(image: DataFrame, shape: tuple[int, int, int], factors: tuple[float, float, float], column: str = "value") -> DataFrame:
    """(z, y, x, value) of the whole image, its sides multiplied by the factors and rounded, interpolated by cubic splines; places without a row
    are 0. Splines of an image are splines along its axes in turn, so each axis takes a pass over lines; every line that has a row becomes
    dense. An image without rows has none."""
    rows = image.select(*[F.col(a).cast("int") for a in AT], F.col(column).cast("double").alias("value"))
    for axis, size, factor in zip(AT, shape, factors):
        new, others = max(1, round(size * factor)), [a for a in AT if a != axis]
        if new == size:
            continue
        place, weight = taps(size, new)

        def one(c: Columns, line: np.ndarray, axis=axis, size=size, new=new, others=others, place=place, weight=weight) -> Columns:
            first = np.flatnonzero(np.diff(line, prepend=-1))
            values = []
            for some in np.array_split(np.arange(len(first)), max(1, len(first) * max(size, 4 * new) // AT_ONCE)):
                if not len(some):
                    continue
                rows = slice(first[some[0]], first[some[-1] + 1] if some[-1] + 1 < len(first) else len(line))
                dense = np.zeros((len(some), size))
                dense[line[rows] - some[0], c[axis][rows]] = c["value"][rows]
                values.append(np.einsum("lnt,nt->ln", coefficients(dense)[:, place], weight).ravel())
            return {axis: np.tile(np.arange(new, dtype=np.int32), len(first)), **{o: np.repeat(c[o][first], new) for o in others}, "value": np.concatenate(values)}

        rows = by_lines(rows, others, axis, one, "z int, y int, x int, value double")
    return rows.select(*AT, "value")
