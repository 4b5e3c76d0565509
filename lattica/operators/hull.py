"""Convex hulls of voxels, exact in whole numbers, in any dimension that the voxels span.

A voxel inside a row of voxels is no corner, nor is one inside a layer's hull; so rows send their two ends, layers the corners of their flat hull,
tasks the corners of what layers they hold, and the hull of those corners is the hull of all. Its half-spaces, as many as an image's side to the
power of one and a half at most, are broadcast, and every row of the image between them is an interval.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..helpers import settle
from ..model import Scale
from .distance import AT

#: Coordinates span less than this where 64-bit products are exact; wider ones are Python's integers.
NARROW = 1 << 18
#: Corners that a task makes one hull of at a time, and products that are in memory at a time.
AT_ONCE, PRODUCTS = 1 << 16, 1 << 23


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a[..., 1] * b[..., 2] - a[..., 2] * b[..., 1], a[..., 2] * b[..., 0] - a[..., 0] * b[..., 2], a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]], -1)


def _whole(points: np.ndarray) -> np.ndarray:
    """Distinct points, of a type in which their products are exact."""
    p = np.unique(np.asarray(points, np.int64).reshape(-1, 3), axis=0)
    return p if not len(p) or int((p.max(0) - p.min(0)).max()) < NARROW else p.astype(object)


def _basis(p: np.ndarray) -> list[int]:
    """Rows of up to four points that span what all points span: each is the farthest from what the ones before it span."""
    rows, d = [0], p - p[0]
    far = (d * d).sum(1)
    if far.max() == 0:
        return rows
    rows.append(int(np.argmax(far)))
    n = _cross(d[rows[1]][None], d)
    area = np.abs(n).max(1)
    if area.max() == 0:
        return rows
    rows.append(int(np.argmax(area)))
    away = np.abs((d * n[rows[2]]).sum(1))
    if away.max() > 0:
        rows.append(int(np.argmax(away)))
    return rows


def _ring(p: np.ndarray, normal: np.ndarray) -> list[int]:
    """Corners of points in a plane, in order around it: chains of the points sorted along one axis, seen along the normal's longest one."""
    drop = int(np.argmax(np.abs(normal)))
    u, v = [a for a in range(3) if a != drop]
    order = sorted(range(len(p)), key=lambda i: (p[i, u], p[i, v]))

    def chain(rows):
        out: list[int] = []
        for i in rows:
            while len(out) > 1 and (p[out[-1], u] - p[out[-2], u]) * (p[i, v] - p[out[-2], v]) <= (p[out[-1], v] - p[out[-2], v]) * (p[i, u] - p[out[-2], u]):
                out.pop()
            out.append(i)
        return out

    return chain(order)[:-1] + chain(order[::-1])[:-1]


def _faces(p: np.ndarray, start: list[int]) -> np.ndarray:
    """Triangles around points that span space, their corners anticlockwise from outside: a point beyond some faces replaces them by a cone over
    the edge of what it sees."""
    middle = p[start].sum(0)  # of four points, so four times the place
    faces = np.array([[start[i] for i in range(4) if i != skip] for skip in range(4)])

    def planes(f):
        a = p[f[:, 0]]
        n = _cross(p[f[:, 1]] - a, p[f[:, 2]] - a)
        return n, (n * a).sum(1)

    n, c = planes(faces)
    flip = (n * middle).sum(1) > 4 * c
    faces[flip] = faces[flip][:, ::-1]
    n, c = planes(faces)
    # far points first, so that most others are inside soon and are never looked at alone
    spread = (4 * p - middle).astype(float)
    left = np.argsort(-(spread * spread).sum(1), kind="stable")
    left = left[~np.isin(left, start)]
    while len(left):
        now, left = left[: len(faces)], left[len(faces) :]
        for i in now:
            seen = n @ p[i] > c
            if not seen.any():
                continue
            edges = np.concatenate([faces[seen][:, [0, 1]], faces[seen][:, [1, 2]], faces[seen][:, [2, 0]]])
            there, back = edges[:, 0] * len(p) + edges[:, 1], edges[:, 1] * len(p) + edges[:, 0]
            rim = edges[~np.isin(back, there)]
            new = np.column_stack([rim, np.full(len(rim), i)])
            n_new, c_new = planes(new)
            faces, n, c = np.concatenate([faces[~seen], new]), np.concatenate([n[~seen], n_new]), np.concatenate([c[~seen], c_new])
        outside = [(part @ n.T > c).any(1) for part in np.array_split(p[left], max(1, len(left) * len(n) // PRODUCTS))]
        left = left[np.concatenate(outside).astype(bool)]
    return faces


def corners(points: np.ndarray) -> np.ndarray:
    """The points of a set that its hull needs; collinear and coplanar ones may be among them where the set spans space."""
    p = _whole(points)
    if not len(p):
        return p
    p0 = p - p[0]
    basis = _basis(p0)
    if len(basis) < 3:
        keep = basis if len(basis) == 1 else [min(range(len(p)), key=lambda i: tuple(p[i])), max(range(len(p)), key=lambda i: tuple(p[i]))]
    elif len(basis) == 3:
        keep = _ring(p0, _cross(p0[basis[1]] - p0[basis[0]], p0[basis[2]] - p0[basis[0]]))
    else:
        keep = np.unique(_faces(p0, basis))
    return p[np.asarray(keep)].astype(np.int64)


def half_spaces(points: np.ndarray) -> np.ndarray:
    """Rows (nz, ny, nx, c): places inside the hull are those with n . place <= c for all; a flat set has both sides of its plane, a straight or
    single one likewise. Normals are in lowest terms, each once."""
    p = _whole(points)
    origin, p = [int(x) for x in p[0]], p - p[0]
    basis, found = _basis(p), []
    both = lambda n, at: [(n, (n * at).sum()), (-n, (-n * at).sum())]
    units = np.eye(3, dtype=np.int64).astype(p.dtype)
    if len(basis) == 1:
        for e in units:
            found += both(e, p[0])
    elif len(basis) == 2:
        d = p[basis[1]] - p[basis[0]]
        for e in units:
            n = _cross(d[None], e[None])[0]
            if n.any():
                found += both(n, p[0])
        ends = (p * d).sum(1)
        found += [(d, ends.max()), (-d, -ends.min())]
    elif len(basis) == 3:
        n = _cross((p[basis[1]] - p[basis[0]])[None], (p[basis[2]] - p[basis[0]])[None])[0]
        n = n // gcd(*map(int, n))
        found += both(n, p[0])
        ring = _ring(p, n)
        for i, j in zip(ring, ring[1:] + ring[:1]):
            side = _cross((p[j] - p[i])[None], n[None])[0]
            at = (p * side).sum(1)
            c = (p[i] * side).sum()
            found.append((side, c) if at.max() == c else (-side, -c))
    else:
        faces = _faces(p, basis)
        a = p[faces[:, 0]]
        n = _cross(p[faces[:, 1]] - a, p[faces[:, 2]] - a)
        found = list(zip(n, (n * a).sum(1)))
    rows = set()
    for n, c in found:
        g = gcd(*map(int, n))
        n = [int(x) // g for x in n]
        rows.add((*n, int(c) // g + sum(x * o for x, o in zip(n, origin))))
    return np.array(sorted(rows), object)


def _farthest(p: np.ndarray, steps: np.ndarray) -> float:
    """The greatest distance between two of the points, whose coordinates are in units of `steps`."""
    c = p * steps
    return max(float(((part[:, None] - c[None]) ** 2).sum(2).max()) for part in np.array_split(c, max(1, len(c) ** 2 // PRODUCTS))) ** 0.5


def spans(voxels: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """(label, span): the greatest distance between two voxels of each label. Both are corners of the label's hull, so rows send their ends, layers
    the corners of theirs, and only the corners of a hull are compared with one another."""
    steps = np.array([scale.z, scale.xy, scale.xy], float)
    rows = voxels.groupBy("label", "z", "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))

    def layer(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = np.concatenate([pdf[["z", "y", "lo"]].to_numpy(np.int64), pdf[["z", "y", "hi"]].to_numpy(np.int64)])
        return pd.DataFrame(corners(ends), columns=AT).assign(label=pdf["label"].iloc[0])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "span": [_farthest(corners(pdf[AT].to_numpy(np.int64)), steps)]})

    return rows.groupBy("label", "z").applyInPandas(layer, "z long, y long, x long, label long").groupBy("label").applyInPandas(whole, "label long, span double")


def merged(voxels: DataFrame) -> np.ndarray:
    """The corners of the hull of all voxels, gathered from rows, layers and tasks."""
    rows = voxels.groupBy("z", "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))

    def layer(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = np.concatenate([pdf[["z", "y", "lo"]].to_numpy(np.int64), pdf[["z", "y", "hi"]].to_numpy(np.int64)])
        return pd.DataFrame(corners(ends), columns=AT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(np.column_stack([c.to_numpy() for c in batch.columns]))
            n += len(batch)
            if n >= AT_ONCE:
                held = [corners(np.concatenate(held))]
                n = 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, corners(np.concatenate(held)).T.copy())], AT)

    schema = "z long, y long, x long"
    layers = settle(rows.groupBy("z").applyInPandas(layer, schema), "layers")
    parts = settle(layers.mapInArrow(run, schema), "corners")
    # what is left grows with the surface of the hull, not with the voxels
    return corners(np.array([tuple(r) for r in parts.coalesce(1).mapInArrow(run, schema).collect()], np.int64).reshape(-1, 3))


def filled(voxels: DataFrame) -> DataFrame:
    """(z, y, x) of all places in the convex hull of the voxels, its surface included. A set that spans only a plane, a line or a place has a hull
    of that dimension; an empty one has none."""
    spark = voxels.sparkSession
    p = merged(voxels.select(*[F.col(a).cast("long") for a in AT]))
    if not len(p):
        return spark.createDataFrame([], "z int, y int, x int")
    spaces = half_spaces(p)
    narrow = int(np.abs(p).max()) < NARROW
    sent = spark.sparkContext.broadcast(spaces.astype(np.int64) if narrow else spaces)
    lo, hi = p.min(0), p.max(0)
    lines = spark.range(int(lo[0]), int(hi[0]) + 1).select(F.col("id").alias("z"), F.explode(F.sequence(F.lit(int(lo[1])).cast("long"), F.lit(int(hi[1])).cast("long"))).alias("y"))
    x_lo, x_hi = int(lo[2]), int(hi[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sent.value
        flat, up, down = (n[s] for s in (n[:, 2] == 0, n[:, 2] > 0, n[:, 2] < 0))
        for batch in batches:
            at = np.column_stack([c.to_numpy() for c in batch.columns]).astype(n.dtype)
            for some in np.array_split(at, max(1, len(at) * len(n) // PRODUCTS)):
                room = lambda s: s[:, 3] - some @ s[:, :2].T  # noqa: B023, E731  what is left for nx * x
                ok = (room(flat) >= 0).all(1)
                first = np.maximum((-(room(down) // -down[:, 2])).max(1), x_lo) if len(down) else np.full(len(some), x_lo)
                last = np.minimum((room(up) // up[:, 2]).min(1), x_hi) if len(up) else np.full(len(some), x_hi)
                ok &= (first <= last).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (some[ok, 0], some[ok, 1], first[ok], last[ok])], ["z", "y", "first", "last"])

    rows = lines.mapInArrow(run, "z long, y long, first long, last long")
    return rows.select("z", "y", F.explode(F.sequence("first", "last")).alias("x")).select(*[F.col(a).cast("int") for a in AT])
