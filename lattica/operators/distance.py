"""Distances to the nearest feature and to the nearest place outside, axis by axis.

A squared distance is a sum over the axes, so the nearest feature of a place is found by three passes: each deals the rows by lines along one
axis and finds, for every place of a line, the site on it with the least (squared distance so far, label). Rows of a line are its places only, so
work and shuffles are in proportion to the places within reach, not to the cube of the reach; no task holds an image or an object.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Scale

AT = ["z", "y", "x"]
Columns = dict[str, np.ndarray]


def by_lines(rows: DataFrame, line: list[str], along: str, one: Callable[[Columns, np.ndarray], Columns], schema: str) -> DataFrame:
    """one(columns, number of each row's line) of whole lines, whose rows are in order; a line is the rows that agree in the columns `line`. Lines
    are dealt by hash and pass a task as a stream, a batch and the rest of a line at a time."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []

        def out(columns: Columns) -> pa.RecordBatch:
            cut = np.zeros(len(columns[along]), bool)
            for c in line:
                cut[1:] |= columns[c][1:] != columns[c][:-1]
            found = one(columns, np.cumsum(cut))
            return pa.RecordBatch.from_arrays([pa.array(found[n]) for n in names], names)

        for batch in batches:
            new = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns)}
            if not len(batch):
                continue
            other = np.zeros(len(batch), bool)
            for c in line:
                other |= new[c] != new[c][-1]
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0  # where the last line begins
            if cut or held and any(held[-1][c][-1] != new[c][0] for c in line):
                yield out({c: np.concatenate([*(h[c] for h in held), new[c][:cut]]) for c in new})
                held = []
            held.append({c: v[cut:] for c, v in new.items()})
        if held:
            yield out({c: np.concatenate([h[c] for h in held]) for c in held[0]})

    return rows.repartition(*line).sortWithinPartitions(*line, along).mapInArrow(run, schema)


def least_on_lines(line: np.ndarray, at: np.ndarray, cost: np.ndarray, label: np.ndarray, to_line: np.ndarray, to: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """For each place (to_line, to) the least ((step * (to - at))**2 + cost, label) over the sites of its line; sites and places are sorted, and a line
    of places has a site.

    Parabolas of one width cross once, so the best site moves only forward with the place: the middle place of each stretch is settled among
    the stretch's sites, its left half goes on with the sites up to the best one and its right half with those from it on. All stretches of all
    lines take a step together; a step looks at each site about once, and the steps are the logarithm of a line's places."""
    value, name = np.empty(len(to)), np.empty(len(to), label.dtype)
    lines, first = np.unique(to_line, return_index=True)
    lo, hi = first, np.append(first[1:], len(to))
    s_lo, s_hi = np.searchsorted(line, lines, "left"), np.searchsorted(line, lines, "right")
    while len(lo):
        mid, count = (lo + hi) // 2, s_hi - s_lo
        begin = np.cumsum(count) - count
        site = np.arange(int(count.sum())) + np.repeat(s_lo - begin, count)
        d = (step * (np.repeat(to[mid], count) - at[site])) ** 2 + cost[site]
        least = np.minimum.reduceat(d, begin)
        tied = d == np.repeat(least, count)
        l = np.where(tied, label[site], np.iinfo(label.dtype).max)
        small = np.minimum.reduceat(l, begin)
        best = np.minimum.reduceat(np.where(tied & (l == np.repeat(small, count)), site, len(at)), begin)
        value[mid], name[mid] = least, small
        left, right = lo < mid, mid + 1 < hi
        lo, hi, s_lo, s_hi = np.concatenate([lo[left], mid[right] + 1]), np.concatenate([mid[left], hi[right]]), np.concatenate([s_lo[left], best[right]]), np.concatenate([best[left] + 1, s_hi[right]])
    return value, name


def _reached(line: np.ndarray, at: np.ndarray, reach: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, place) of all places from 0 to size - 1 within reach of a site, once each, in order."""
    wide = size + 2
    lo, hi = np.clip(at - reach, 0, size), np.clip(at + reach, -1, size - 1)
    some = lo <= hi
    lo, hi = (line * wide + lo)[some], (line * wide + hi)[some]
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1] + 1])) if len(lo) else np.empty(0, np.int64)
    lo, hi = lo[new], hi[np.append(new[1:], len(hi)) - 1] if len(new) else lo
    size_of = hi - lo + 1
    key = np.arange(int(size_of.sum())) + np.repeat(lo - (np.cumsum(size_of) - size_of), size_of)
    return key // wide, key % wide


def steps(scale: Scale) -> dict[str, float]:
    return {"z": scale.z, "y": scale.xy, "x": scale.xy}


def nearest(features: DataFrame, radius: float, shape: tuple[int, int, int], scale: Scale = Scale(), each: bool = False) -> DataFrame:
    """(z, y, x, label, d2) of all places of the image at a distance of at most radius from a feature (z, y, x, label): the label of the nearest
    one, the smaller of equally near ones, and the squared distance. With `each` a place has a row for every label within the radius."""
    most = float(radius) * float(radius)
    rows = features.select(*[F.col(a).cast("int") for a in AT], F.col("label").cast("long"), F.lit(0.0).alias("d2"))
    passes = [(a, n) for a, n in zip(AT, shape) if n > 1] or [("x", shape[2])]
    for axis, size in passes:
        others, step = [a for a in AT if a != axis], float(steps(scale)[axis])

        def one(c: Columns, line: np.ndarray, axis=axis, size=size, others=others, step=step) -> Columns:
            at = c[axis].astype(np.int64)
            reach = np.floor(np.sqrt(np.maximum(most - c["d2"], 0)) / step).astype(np.int64) + 1  # one more, for what rounding takes
            to_line, to = _reached(line, at, reach, size)
            d2, label = least_on_lines(line, at, c["d2"], c["label"], to_line, to, step)
            near = d2 <= most
            first = np.searchsorted(line, to_line[near])
            return {axis: to[near].astype(np.int32), **{o: c[o][first] for o in others}, "label": label[near], "d2": d2[near]}

        rows = by_lines(rows, [*others, "label"] if each else others, axis, one, "z int, y int, x int, label long, d2 double")
    return rows.where(" AND ".join(f"{a} BETWEEN 0 AND {n - 1}" for a, n in zip(AT, shape) if n == 1) or "true")


def squared_depths(voxels: DataFrame, scale: Scale = Scale(), axes: tuple[str, ...] = ("z", "y", "x"), by: str = "label", also: str | None = None) -> DataFrame:
    """(z, y, x, label, d2): each voxel's squared distance, along the given axes, to the nearest place that does not belong to the same label (or
    other column `by`); `also` is a number that comes along. A line's voxels of a label are runs; the way out of a run along its line is its
    ends, and what lies beyond is no nearer."""
    more = [also] if also else []
    rows = voxels.select(*[F.col(a).cast("int") for a in AT], F.col(by).cast("long").alias("label"), F.lit(float("inf")).alias("d2"), *[F.col(c).cast("double") for c in more])
    for axis in axes:
        others, step = [a for a in AT if a != axis], float(steps(scale)[axis])

        def one(c: Columns, line: np.ndarray, axis=axis, others=others, step=step) -> Columns:
            at = c[axis].astype(np.int64)
            new = np.concatenate([[True], (line[1:] != line[:-1]) | (at[1:] > at[:-1] + 1)])
            run, first = np.cumsum(new) - 1, np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            known, none = np.isfinite(c["d2"]), np.zeros(2 * len(first))
            site, cost = np.concatenate([at[known], at[first] - 1, at[last] + 1]), np.concatenate([c["d2"][known], none])
            of = np.concatenate([run[known], run[first], run[last]])
            order = np.lexsort((site, of))
            d2, _ = least_on_lines(of[order], site[order], cost[order], np.zeros(len(of), np.int64), run, at, step)
            return {a: c[a] for a in (*AT, "label", *more)} | {"d2": d2}

        rows = by_lines(rows, [*others, "label"], axis, one, ", ".join(["z int, y int, x int, label long, d2 double", *(f"{c} double" for c in more)]))
    return rows
