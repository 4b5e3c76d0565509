"""Spatial joins and point statistics on centroids (id, z, y, x)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..helpers import grid_join, knn_join, settle
from ..model import Scale
from . import blockwise
from .distance import squared_depths
from .edges import without_duplicates

AXES = ("z", "y", "x")
#: Points of a chunk of Ripley's K.
CHUNK = 1024


def truncated(centroids: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Centroids in units of the finer axis, coordinates cut to integers."""
    k = {a: (scale.z if a == "z" else scale.xy) / scale.least for a in AXES}
    return centroids.select("id", *[(F.col(a) * F.lit(k[a])).cast("int").alias(a) for a in AXES])


def radius_network(centroids: DataFrame, radius: float, targets: DataFrame | None = None) -> DataFrame:
    """Edges to all others within the radius, ends included, both directions; with targets (id) only from these."""
    left = centroids if targets is None else centroids.join(targets.select("id").distinct(), "id", "left_semi")
    pairs = grid_join(left, centroids, radius).where("l.id <> r.id")
    return pairs.select(F.col("l.id").alias("node_a"), F.col("r.id").alias("node_b"), F.lit(0).cast("long").alias("edge_c"))


def nearest_network(centroids: DataFrame, k: int, radius: float | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Edges to the k nearest others, ties by id, within the radius if there is one."""
    left = centroids if targets is None else centroids.join(targets.select("id").distinct(), "id", "left_semi")
    return knn_join(left, centroids, k, radius).select(F.col("q").alias("node_a"), F.col("n").alias("node_b"), F.lit(0).cast("long").alias("edge_c"))


def proximity_network(centroids: DataFrame, distance: float, scale: Scale = Scale(), k: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """The network of centroids within a distance (of at most k nearest ones), each pair once. Distances are measured between truncated
    coordinates in units of the finer axis. Ids must be unique."""
    points, r = truncated(centroids, scale), distance / scale.least
    if k is None and targets is None:
        return blockwise.pairs(points, r)
    edges = radius_network(points, r, targets) if k is None else nearest_network(points, k, r, targets)
    return without_duplicates(edges)


def nearest_distances(roots: DataFrame, targets: DataFrame, k: int = 1, scale: Scale = Scale()) -> DataFrame:
    """(id, dist): the mean distance of a root to its k nearest targets; a point is never its own target."""
    near = knn_join(roots, targets, k, scale=scale)
    return near.groupBy(F.col("q").alias("id")).agg(F.avg(F.sqrt("d2")).alias("dist"))


def identity_distances(centroids: DataFrame, identities: DataFrame, k: int = 1, scale: Scale = Scale()) -> DataFrame:
    """(root, target, dist): the mean over nodes of one identity of their distance to the nearest of another. Identities are a further axis of
    the join: a node seeks its neighbours once in the points of each identity, so one join serves all of them."""
    each = settle(centroids.join(identities.select("id", F.explode("ids").alias("identity")).distinct(), "id"), "identities")
    # one row with the identities there are; the result has a distance for each node and identity anyhow
    names = F.broadcast(each.agg(F.collect_set("identity").alias("names")))
    queries = centroids.crossJoin(names).select(*centroids.columns, F.explode("names").alias("identity"))
    near = knn_join(queries, each, k, scale=scale, by="identity")
    dist = near.groupBy(F.col("q").alias("id"), F.col("identity").alias("target")).agg(F.avg(F.sqrt("d2")).alias("dist"))
    return dist.join(identities.select("id", F.explode("ids").alias("root")), "id").groupBy("root", "target").agg(F.avg("dist").alias("dist"))


def expected_nearest(count: int, shape: tuple[int, int, int], scale: Scale = Scale()) -> float:
    """The nearest-neighbour distance of `count` points spread evenly over the voxels of a box, taken along their running number: the least
    distance of a point in the middle to the two beside it."""
    total = shape[0] * shape[1] * shape[2]
    step = max(1, total // max(count, 1))
    at = lambda i: (i // (shape[1] * shape[2]) * scale.z, i // shape[2] % shape[1] * scale.xy, i % shape[2] * scale.xy)
    mid = at(min(total - 1, count // 2 * step))
    beside = [at(i) for i in (count // 2 * step - step, count // 2 * step + step) if 0 <= i < total]
    return min((math.dist(mid, b) for b in beside), default=0.0)


def nearest_heat(distances: DataFrame, expected: float) -> DataFrame:
    """(id, heat): logarithm of the expected distance over a node's own; infinite where two share a place."""
    heat = F.when(F.col("dist") == 0, F.lit(math.inf)).otherwise(F.log(F.lit(float(expected)) / F.col("dist")))
    return distances.select("id", heat.alias("heat"))


def radial_distribution(centroids: DataFrame, graph: DataFrame, step: float, scale: Scale = Scale()) -> DataFrame:
    """(r, value): how many edge ends lie at a distance of r - step to r, both bounds included, over the greatest id. An edge counts from
    both ends; a distance on a bound counts on both sides of it."""
    d = lambda a: F.pow((F.col(f"a.{a}") - F.col(f"b.{a}")) * F.lit(scale.z if a == "z" else scale.xy), F.lit(2.0))
    a, b, g = centroids.alias("a"), centroids.alias("b"), graph.alias("g")
    dist = g.join(a, F.col("g.src") == F.col("a.id")).join(b, F.col("g.dst") == F.col("b.id")).select(F.sqrt(d("z") + d("y") + d("x")).alias("d"))
    low = F.floor(F.col("d") / step)
    buckets = F.when(F.col("d") == low * step, F.filter(F.array(low - 1, low), lambda i: i >= 0)).otherwise(F.array(low))
    per = dist.select(F.explode(buckets).alias("i")).groupBy("i").agg((2 * F.count("*")).alias("n"))
    most = F.broadcast(dist.agg(F.floor(F.max("d") / step).alias("most")).crossJoin(centroids.agg(F.max("id").alias("top"))))
    grid = most.select("top", F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("i"))
    return grid.join(per, "i", "left").select(((F.col("i") + 1) * step).alias("r"), (F.coalesce("n", F.lit(0)) / F.col("top")).alias("value"))


def radii(shape: tuple[float, ...], step: float, proportion: float = 0.5) -> list[float]:
    """Radii from step to proportion times the shortest side, sides of 1 left out."""
    sides = [s for s in shape if s != 1]
    most = min(sides) * proportion
    n = int(most / step)
    return [step + i * (most - step) / (n - 1) for i in range(n)] if n > 1 else [step] * n


def mirrored(points: DataFrame, shape: tuple[float, ...], margin: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """The points and their mirror images over each face, edge and corner of the box [0, side] they are within the margin of."""
    out = []
    for direction in product((-1, 0, 1), repeat=len(axes)):
        if not any(direction):
            continue
        near, now = F.lit(True), []
        for a, d, side in zip(axes, direction, shape):
            if d < 0:
                near, value = near & (F.col(a) < margin), -F.col(a)
            elif d > 0:
                near, value = near & (side - F.col(a) < margin), 2 * side - F.col(a)
            else:
                value = F.col(a)
            now.append(value.cast("double").alias(a))
        out.append(F.when(near, F.struct(*now)))
    own = F.struct(*[F.col(a).cast("double").alias(a) for a in axes])
    rest = [c for c in points.columns if c not in axes]
    return points.select(*rest, F.explode(F.array_compact(F.array(own, *out))).alias("p")).select(*rest, "p.*")


def _chunks(points: DataFrame, side: float, axes: tuple[str, ...], which: str) -> DataFrame:
    """(c<axis>_<which>, chunk_<which>, <axis>_<which>: array): the points of each cell of a grid in chunks of about CHUNK, so that a crowded cell is many rows."""
    cell = [F.floor(F.col(a) / side).cast("long").alias(f"c{a}_{which}") for a in axes]
    keys = [f"c{a}_{which}" for a in axes]
    rows = settle(points.select(*[F.col(a).cast("double").alias(f"{a}_{which}") for a in axes], *cell, F.monotonically_increasing_id().alias("row")), "points")
    counts = settle(rows.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK).alias("chunks")), "cells")
    dealt = rows.join(counts, keys).withColumn(f"chunk_{which}", F.pmod(F.xxhash64("row"), F.col("chunks")))
    return settle(dealt.groupBy(*keys, f"chunk_{which}").agg(*[F.collect_list(f"{a}_{which}").alias(f"{a}_{which}") for a in axes]), "chunks")


def _squares(rs: list[float]) -> list[float]:
    """For each radius the greatest number whose root is not above it."""
    out = []
    for r in rs:
        t = r * r
        while t > 0 and math.sqrt(t) > r:
            t = math.nextafter(t, 0.0)
        while math.sqrt(math.nextafter(t, math.inf)) <= r:
            t = math.nextafter(t, math.inf)
        out.append(t if r >= 0 else -1.0)
    return out


def _within(p: np.ndarray, q: np.ndarray, squares: list[float]) -> list[int]:
    """How many pairs of a point of p and one of q (an axis a row) have a squared distance of at most each of some numbers. Whole coordinates whose
    squares single precision holds are multiplied as matrices, which is exact; where the boxes of p and q decide, nothing is compared."""
    low, high = np.minimum(p.min(1), q.min(1)), np.maximum(p.max(1), q.max(1))
    gap = np.maximum(0, np.maximum(p.min(1) - q.max(1), q.min(1) - p.max(1)))
    wide = np.maximum(p.max(1) - q.min(1), q.max(1) - p.min(1))
    least, most = float((gap**2).sum()) * (1 - 1e-9), float((wide**2).sum()) * (1 + 1e-9)
    if all(t < least or t >= most for t in squares):
        return [p.shape[1] * q.shape[1] if t >= most else 0 for t in squares]
    whole = bool((p == np.rint(p)).all() and (q == np.rint(q)).all() and (high - low).max() < 1000)
    if whole:
        a, b = (p - np.floor(low)[:, None]).astype(np.float32), (q - np.floor(low)[:, None]).astype(np.float32)
        one = np.concatenate([-2 * a, (a * a).sum(0)[None], np.ones((1, a.shape[1]), np.float32)])
        d2 = one.T @ np.concatenate([b, np.ones((1, b.shape[1]), np.float32), (b * b).sum(0)[None]])
        limits = [np.float32(min(math.floor(t), (1 << 24) - 1)) for t in squares]
    else:
        d2, limits = sum((x[:, None] - y[None]) ** 2 for x, y in zip(p, q)), squares
    return [p.shape[1] * q.shape[1] if t >= most else 0 if t < least else int(np.count_nonzero(d2 <= limit)) for t, limit in zip(squares, limits)]


def ripley_k(roots: DataFrame, targets: DataFrame, rs: list[float], volume: float, same: bool = True, axes: tuple[str, ...] = AXES, targets_counted: int | None = None) -> DataFrame:
    """(r, k): pairs of a root and a target within r, the roots' own places taken out if they are targets too, over targets times the
    density of roots.

    Points are put together in chunks by the cells of a grid of the greatest radius; chunks of neighbouring cells meet, and each two give
    the number of their pairs within each radius, so that no pair of points is ever a row. Chunks that meet are few bytes and much work, so
    they are dealt out anew."""
    if not rs:
        return roots.sparkSession.createDataFrame([], "r double, k double")
    side, grid, spark = max(rs), [float(r) for r in rs], roots.sparkSession
    squares = _squares(grid)
    a, b = _chunks(roots, side, axes, "a"), _chunks(targets, side, axes, "b")
    near = F.array(*[F.struct(*[F.lit(d).alias(x) for x, d in zip(axes, o)]) for o in product((-1, 0, 1), repeat=len(axes))])
    ka, kb = [f"c{x}_a" for x in axes] + ["chunk_a"], [f"c{x}_b" for x in axes] + ["chunk_b"]
    moved = a.select(*ka, F.explode(near).alias("o")).select(*ka, *[(F.col(f"c{x}_a") + F.col(f"o.{x}")).alias(f"c{x}_b") for x in axes])
    met = moved.join(b.select(*kb), kb[:-1]).join(a, ka).join(b, kb)
    columns = [f"{x}_{w}" for w in "ab" for x in axes]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(grid), np.int64), len(axes)
        for batch in batches:
            for row in zip(*batch.columns):
                at = [v.values.to_numpy(zero_copy_only=False) for v in row]
                total += _within(np.stack(at[:n]), np.stack(at[n:]), squares)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(total)], ["i", "n"])

    dealt = met.select(*columns).repartition(8 * spark.sparkContext.defaultParallelism)
    per = dealt.mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))
    n = F.broadcast(roots.agg(F.count("*").alias("n_roots")).crossJoin(targets.agg(F.count("*").alias("n_targets"))))
    every = spark.createDataFrame(list(enumerate(grid)), "i int, r double")
    rows = every.join(per, "i", "left").crossJoin(n).withColumn("pairs", F.coalesce("n", F.lit(0)) - (F.col("n_roots") if same else F.lit(0)))
    counted = F.lit(targets_counted) if targets_counted is not None else F.col("n_targets")
    return rows.select("r", F.try_divide("pairs", counted * F.col("n_roots") / F.lit(float(volume))).alias("k"))


def ripley_h(k: DataFrame, dimensions: int = 3) -> DataFrame:
    h = F.sqrt(F.col("k") / math.pi) if dimensions == 2 else F.cbrt(F.col("k") / (4 * math.pi / 3))
    return k.select("r", "k", (h - F.col("r")).alias("h"))


def ripley(centroids: DataFrame, shape: tuple[float, float, float], step: float, roots: DataFrame | None = None, targets: DataFrame | None = None, proportion: float = 0.5, border: float = 0.0, mirror: bool = False, scale: Scale = Scale()) -> DataFrame:
    """(r, k, h, theory) of roots around targets (ids; all nodes if None). Roots nearer to a face than `border` times the side are left out.
    Sides of one voxel are dropped, and the statistics are those of the plane."""
    sides = [s * (scale.z if a == "z" else scale.xy) for a, s in zip(AXES, shape)]
    axes = tuple(a for a, s in zip(AXES, shape) if s > 1)
    flat = [s for s, n in zip(sides, shape) if n > 1]
    points = centroids.select("id", *[(F.col(a) * F.lit(float(scale.z if a == "z" else scale.xy))).alias(a) for a in axes])
    pick = lambda ids: points if ids is None else points.join(ids.select("id").distinct(), "id", "left_semi")
    r, t = pick(roots), pick(targets)
    for a, s in zip(axes, flat):
        if border:
            r = r.where((F.col(a) > border * s) & (F.col(a) < s - border * s))
    rs = radii(tuple(flat), step, proportion)
    n = t.count() if mirror else None
    t = mirrored(t, tuple(flat), max(rs, default=0.0), axes) if mirror else t
    k = ripley_h(ripley_k(r, t, rs, math.prod(flat), same=roots is targets or (roots is None and targets is None), axes=axes, targets_counted=n), len(axes))
    theory = math.pi * F.col("r") ** 2 if len(axes) == 2 else 4 / 3 * math.pi * F.col("r") ** 3
    return k.withColumn("theory", theory)


def ripley_within(points: DataFrame, mask: DataFrame, step: float, factor: float = 0.25, roots: DataFrame | None = None, targets: DataFrame | None = None, proportion: float = 0.5, safe: bool = False, flat: bool = False, scale: Scale = Scale()) -> DataFrame:
    """(r, k, h, theory, roots) of points (id and whole places) in a mask (z, y, x): the volume is the mask's, and roots (ids; all points if None)
    are those at places deeper in the mask than `factor` of its greatest depth. Radii go up to `proportion` of the shortest side of the points'
    bounds, or with safe to the depth that roots have at least. In the plane with flat.

    Depths are found line by line over the whole mask (`distance`), so neither the mask nor its border is ever in one task; a root finds its own
    depth by its place."""
    axes = ("y", "x") if flat else AXES
    unit = {a: float(scale.z if a == "z" else scale.xy) for a in AXES}
    deep = settle(squared_depths(mask.select(*AXES).distinct().withColumn("label", F.lit(1)), scale, axes).select(*AXES, F.sqrt("d2").alias("depth")), "depths")
    facts = deep.agg(F.count("*").alias("n"), F.max("depth").alias("deepest")).first()
    least = factor * (facts.deepest or 0.0)
    pick = lambda ids: points if ids is None else points.join(ids.select("id").distinct(), "id", "left_semi")
    scaled = lambda df: df.select("id", *[(F.col(a) * F.lit(unit[a])).alias(a) for a in axes])
    inner = settle(scaled(pick(roots).join(deep.where(F.col("depth") > least).select(*AXES), list(AXES), "left_semi")), "roots")
    bounds = points.agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
    sides = tuple(float(bounds[a] or 0) * unit[a] for a in axes)
    most = least if safe else proportion * min(sides)
    n = int(most / step)
    rs = [step + i * (most - step) / max(n - 1, 1) for i in range(n)]
    volume = facts.n * math.prod(unit[a] for a in axes)
    k = ripley_h(ripley_k(inner, scaled(pick(targets)), rs, volume, same=targets is None or roots is targets, axes=axes), len(axes))
    theory = math.pi * F.col("r") ** 2 if len(axes) == 2 else 4 / 3 * math.pi * F.col("r") ** 3
    return k.withColumn("theory", theory).withColumn("roots", F.lit(inner.count()))


def grid_cells(centroids: DataFrame, size: int) -> DataFrame:
    """(id, cell): cubes of a grid over the points' bounds, numbered from 1 by rows; points on the far faces belong to the last cube."""
    lo, hi = [F.min(a).alias(f"lo_{a}") for a in AXES], [F.max(a).alias(f"hi_{a}") for a in AXES]
    facts = F.broadcast(centroids.agg(*lo, *hi))
    n = {a: F.greatest(F.lit(1), F.ceil((F.col(f"hi_{a}") - F.col(f"lo_{a}")) / size)).cast("long") for a in AXES}
    at = {a: F.least(n[a] - 1, F.floor((F.col(a) - F.col(f"lo_{a}")) / size)).cast("long") for a in AXES}
    return centroids.crossJoin(facts).select("id", ((at["z"] * n["y"] + at["y"]) * n["x"] + at["x"] + 1).alias("cell"))


def hexagon_cells(centroids: DataFrame, side: float) -> DataFrame:
    """(id, q, r): axial coordinates of the hexagon of a side length that holds a point in the plane; columns are 1.5 sides apart and every
    other one is shifted by half a hexagon. Rounding the coordinates gives a hexagon that holds the point or touches the one that does, and
    the nearest centre among it and the six around is taken, with no table of centres. Of centres whose squared distances agree to a
    millionth (the point is on a border) the one with the smaller (q, r) is taken."""
    fq, fr = 2.0 / 3.0 * F.col("x") / side, (-1.0 / 3.0 * F.col("x") + math.sqrt(3) / 3.0 * F.col("y")) / side
    rows = centroids.select("id", "x", "y", F.rint(fq).cast("long").alias("q0"), F.rint(fr).cast("long").alias("r0"))

    def centre(dq: int, dr: int):
        q, r = F.col("q0") + dq, F.col("r0") + dr
        dx, dy = F.col("x") - 1.5 * side * q, F.col("y") - side * (math.sqrt(3) / 2 * q + math.sqrt(3) * r)
        return F.struct(F.round(dx * dx + dy * dy, 6).alias("d"), q.alias("q"), r.alias("r"))

    best = F.array_min(F.array(*[centre(dq, dr) for dq, dr in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0), (1, -1), (-1, 1))]))
    return rows.select("id", best.alias("c")).select("id", "c.q", "c.r")


def prism_cells(centroids: DataFrame, side: float, height: float) -> DataFrame:
    """(id, q, r, layer): hexagons in the plane, stacked in layers of a height."""
    return hexagon_cells(centroids, side).join(centroids.select("id", F.floor(F.col("z") / height).cast("long").alias("layer")), "id")


def dodecahedron_cells(centroids: DataFrame, side: float) -> DataFrame:
    """(id, a, b, c): the cell of the face-centred cubic lattice, of spacing sqrt(2) times side, that holds a point: the nearest of the triples
    of an even sum, among those that rounding gives or that differ from them by one. Of cells whose squared distances agree to a billionth
    of a side the one with the smaller (a, b, c) is taken."""
    unit = float(side)
    rows = centroids.select("id", *[(F.col(a) / unit).alias(f"f{a}") for a in AXES]).select("*", *[F.rint(f"f{a}").cast("long").alias(f"r{a}") for a in AXES])

    def cell(o: tuple[int, ...]):
        at = [F.col(f"r{a}") + d for a, d in zip(AXES, o)]
        d2 = sum((F.col(f"f{a}") - p) * (F.col(f"f{a}") - p) for a, p in zip(AXES, at))
        return F.when(F.pmod(at[0] + at[1] + at[2], F.lit(2)) == 0, F.struct(F.round(d2, 9).alias("d"), *[p.alias(n) for p, n in zip(at, "abc")]))

    best = F.array_min(F.array(*[cell(o) for o in product((-1, 0, 1), repeat=3)]))
    return rows.select("id", best.alias("p")).select("id", "p.a", "p.b", "p.c")


def centroid_image(centroids: DataFrame, clip: bool = False) -> DataFrame:
    """Voxels of the centroids, moved to the origin if clip is set; of several in one place the greatest id stays."""
    rows = centroids
    if clip:
        low = F.broadcast(centroids.agg(*[F.min(a).alias(f"lo_{a}") for a in AXES]))
        rows = centroids.crossJoin(low).select("id", *[(F.col(a) - F.col(f"lo_{a}")).alias(a) for a in AXES])
    return rows.groupBy(*AXES).agg(F.max("id").alias("label"))


def scrambled(centroids: DataFrame, seed: int = 42) -> DataFrame:
    """The same places dealt out anew among the ids."""
    from .ranks import numbered

    ids = numbered(centroids.select("id", F.xxhash64("id", F.lit(seed)).alias("h")), "h", "id").select("number", "id")
    places = numbered(centroids.select(*AXES, F.xxhash64("id", F.lit(seed + 1)).alias("h"), F.col("id").alias("o")), "h", "o").select("number", *AXES)
    return ids.join(places, "number").select("id", *AXES)


def nearest_label(grid: DataFrame, centroids: DataFrame) -> DataFrame:
    """Voxels of a grid (z, y, x) with the id of the nearest centroid, ties to the smaller id."""
    points = grid.select(F.xxhash64(*AXES).alias("id"), *AXES)
    near = knn_join(points, centroids, 1, self_join=False)
    return points.join(near.select(F.col("q").alias("id"), F.col("n").alias("label")), "id").select(*AXES, "label")


def angle(a: DataFrame) -> DataFrame:
    """(id, degrees) at the middle of three points given as columns p, q, r of (z, y, x); 0 where two of them coincide."""
    u, v = [F.col(f"p.{c}") - F.col(f"q.{c}") for c in AXES], [F.col(f"r.{c}") - F.col(f"q.{c}") for c in AXES]
    dot = lambda s, t: s[0] * t[0] + s[1] * t[1] + s[2] * t[2]
    norm = F.sqrt(dot(u, u).cast("double")) * F.sqrt(dot(v, v).cast("double"))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(u, v).cast("double"), norm)))
    return a.select("id", F.coalesce(F.degrees(F.acos(F.when(norm > 0, cos))), F.lit(0.0)).alias("degrees"))
