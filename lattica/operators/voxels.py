"""Label images as sparse tables (z, y, x, label): filters, measures, morphology and joins of images.

A voxel without an object has no row. Neighbourhoods are equi-joins on shifted coordinates, so that work is in proportion to the voxels
times the offsets; distances of any length go axis by axis (`distance`).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..helpers import components as _components
from ..helpers import grid_join, least_linked, settle
from ..model import Scale
from .distance import nearest, squared_depths
from .hull import spans

AT = ["z", "y", "x"]
#: Places of the box around an object that one task holds at most.
MOST_BOX = 1 << 28
FACES = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]
SIDES = [f for f in FACES if f[0] == 0]
AROUND = [o for o in product((-1, 0, 1), repeat=3) if any(o)]
HALF = [o for o in AROUND if o > (0, 0, 0)]


def box(sizes: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    return list(product(*(range(-(s // 2), s // 2 + 1) for s in sizes)))


def shifted(voxels: DataFrame, offsets: list[tuple[int, int, int]], scale: Scale | None = None) -> DataFrame:
    """Every voxel at every offset, other columns kept; with a scale also d2, the squared length of the offset."""
    row = lambda o: F.struct(*[F.lit(v).alias(f"d{a}") for v, a in zip(o, AT)], *([F.lit(float((o[0] * scale.z) ** 2 + (o[1] * scale.xy) ** 2 + (o[2] * scale.xy) ** 2)).alias("d2")] if scale else []))
    rest = [c for c in voxels.columns if c not in AT]
    rows = voxels.select("*", F.explode(F.array(*map(row, offsets))).alias("o"))
    return rows.select(*[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AT], *rest, *(["o.d2"] if scale else []))


def inside(voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    return voxels.where(" AND ".join(f"{a} >= 0 AND {a} < {n}" for a, n in zip(AT, shape)))


# Filters


def binarize(value: Column) -> Column:
    return F.when(value != 0, 255).otherwise(0)


def inverted(value: Column) -> Column:
    return F.when(value == 0, 255).otherwise(0)


def otsu(image: DataFrame, column: str = "value", bins: int = 256) -> float:
    """The threshold of the greatest variance between classes, over equal bins from the least to the greatest value: the middle of the bin."""
    lo, hi = image.agg(F.min(column), F.max(column)).first()
    if lo is None or lo == hi:
        return float(lo or 0.0)
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - lo) / ((hi - lo) / bins))).cast("int")
    counts = np.zeros(bins)
    for r in image.groupBy(at.alias("b")).agg(F.count("*").alias("n")).collect():  # a row for each bin
        counts[r.b] = r.n
    mids = lo + (np.arange(bins) + 0.5) * (hi - lo) / bins
    w1, w2 = np.cumsum(counts), counts[::-1].cumsum()[::-1]
    m1, m2 = np.cumsum(counts * mids) / np.maximum(w1, 1), (np.cumsum((counts * mids)[::-1]) / np.maximum(w2[::-1], 1))[::-1]
    return float(mids[np.argmax(w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2)])


def above_share(image: DataFrame, share: float, column: str = "value") -> DataFrame:
    """Rows above the value that stands at `share` of the sorted distinct positive values."""
    from .ranks import numbered

    values = image.where(F.col(column) > 0).select(column).distinct()
    n = values.count()
    cut = numbered(values, column).where(F.col("number") == min(int(n * share), n - 1)).select(F.col(column).alias("cut"))
    return image.join(F.broadcast(cut), F.col(column) > F.col("cut")).select(image.columns)


def masked(image: DataFrame, mask: DataFrame, invert: bool = False) -> DataFrame:
    return image.join(mask.select(AT).distinct(), AT, "left_anti" if invert else "left_semi")


def only_labels(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    return voxels.join(labels.select("label").distinct(), "label", "left_semi").select(*voxels.columns)


def by_measure(voxels: DataFrame, measure: DataFrame, low: float, high: float) -> DataFrame:
    """Voxels of the labels whose number in (id, value) is from low to high."""
    return only_labels(voxels, measure.where(F.col("value").between(low, high)).select(F.col("id").alias("label")))


def crop(voxels: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    return voxels.where(" AND ".join(f"{a} BETWEEN {l} AND {h}" for a, l, h in zip(AT, low, high)))


# Connected components


def connected(voxels: DataFrame, full: bool = True, side: int = 64) -> DataFrame:
    """Voxels with label replaced by a number for each connected component of rows, whatever their labels: 26 neighbours, or 6. Components
    are numbered from 1 in the order of their first voxel.

    Each cube of `side` is labelled by itself in a task; only voxels on the faces of cubes are then joined with their neighbours in other
    cubes, and components are those of the cubes' pieces."""
    offsets = HALF if full else [(0, 0, 1), (0, 1, 0), (1, 0, 0)]
    key = F.col("z").cast("long") * (1 << 42) + F.col("y").cast("long") * (1 << 21) + F.col("x").cast("long")
    cube = [F.floor(F.col(a) / side).cast("long").alias(f"c{a}") for a in AT]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        k = np.sort(pdf["k"].to_numpy(np.int64))
        i, j = [], []
        for z, y, x in offsets:
            to = k + ((z << 42) + (y << 21) + x)
            at = np.minimum(np.searchsorted(k, to), len(k) - 1)
            hit = np.flatnonzero(k[at] == to)
            i.append(k[hit])
            j.append(k[at[hit]])
        node, least = least_linked(np.concatenate(i), np.concatenate(j))
        piece = k.copy()
        piece[np.searchsorted(k, node)] = least
        return pd.DataFrame({"k": k, "piece": piece})

    places = voxels.select(*AT).distinct().select(*AT, key.alias("k"), *cube)
    pieces = places.groupBy("cz", "cy", "cx").applyInPandas(one, "k long, piece long")
    low = (1 << 21) - 1
    back = [F.shiftright("k", 42).cast("int").alias("z"), F.shiftright("k", 21).bitwiseAND(low).cast("int").alias("y"), F.col("k").bitwiseAND(low).cast("int").alias("x")]
    pieces = settle(pieces.select(*back, "piece"), "pieces")
    at_face = F.lit(False)
    for a in AT:
        at_face = at_face | (F.pmod(F.col(a), F.lit(side)) == 0) | (F.pmod(F.col(a), F.lit(side)) == side - 1)
    rim = settle(pieces.where(at_face), "rim")
    moved = shifted(rim, offsets).select(*AT, F.col("piece").alias("other"))
    links = rim.join(moved, AT).where("piece <> other").select(F.col("piece").alias("a"), F.col("other").alias("b")).distinct()
    parts = _components(links, "a", "b")
    rows = settle(pieces.join(parts.withColumnRenamed("id", "piece"), "piece", "left").select(*AT, F.coalesce("component", "piece").alias("component")), "components")
    from .ranks import numbered

    names = numbered(rows.select("component").distinct(), "component", start=1, name="label")
    return rows.join(names, "component").select(*AT, F.col("label").cast("long").alias("label"))


def size_filter(voxels: DataFrame, share: float | None = None, most: int | None = None) -> DataFrame:
    """Components with at least a share of all voxels, or with at most `most`."""
    c = connected(voxels)
    sizes = c.groupBy("label").agg(F.count("*").alias("n"))
    if share is not None:
        keep = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("all")))).where(F.col("n") >= share * F.col("all"))
    else:
        keep = sizes.where(F.col("n") <= most)
    return c.join(keep.select("label"), "label", "left_semi").select(*AT, "label")


def without_largest(voxels: DataFrame, k: int = 1) -> DataFrame:
    """Without the k largest components, ties by number."""
    c = connected(voxels)
    top = c.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k)
    return c.join(top.select("label"), "label", "left_anti").select(*AT, "label")


# Measures


def volumes(voxels: DataFrame, scale: Scale = Scale()) -> DataFrame:
    return voxels.groupBy(F.col("label").alias("id")).agg((F.count("*") * (scale.xy * scale.xy * scale.z)).alias("volume"))


def centroids(voxels: DataFrame, down: int = 1) -> DataFrame:
    """Mean places rounded half to even."""
    return voxels.groupBy(F.col("label").alias("id")).agg(*[(F.rint(F.avg(a)) * down).cast("int").alias(a) for a in AT])


def bounds(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy(F.col("label").alias("id")).agg(*[f(a).alias(f"{n}_{a}") for a in AT for f, n in ((F.min, "lo"), (F.max, "hi"))])


def exposed(voxels: DataFrame, scale: Scale = Scale(), background_only: bool = False, flat: bool = False) -> DataFrame:
    """(id, area): faces towards other labels or none, or only towards none; in the plane the sides. A face has the area of the two axes
    that it spans."""
    area = lambda o: (scale.xy * scale.xy if o[0] else scale.xy * scale.z) if not flat else scale.xy
    faces = SIDES if flat else FACES
    rows = voxels.select(*AT, F.col("label").alias("id"), F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for v, a in zip(o, AT)], F.lit(float(area(o))).alias("area")) for o in faces])).alias("o"))
    rows = rows.select("id", "o.area", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AT])
    met = rows.join(voxels.select(*AT, "label"), AT, "left")
    open_face = F.col("label").isNull() if background_only else F.col("label").isNull() | (F.col("label") != F.col("id"))
    return met.groupBy("id").agg(F.sum(F.when(open_face, F.col("area")).otherwise(0.0)).alias("area"))


def background_share(voxels: DataFrame, scale: Scale = Scale(), flat: bool = False) -> DataFrame:
    """(id, share): the part of an object's surface that meets no other object."""
    return exposed(voxels, scale, flat=flat).join(exposed(voxels, scale, True, flat).withColumnRenamed("area", "open"), "id").select("id", F.try_divide("open", "area").alias("share"))


def sphericity(voxels: DataFrame, scale: Scale = Scale()) -> DataFrame:
    v, a = volumes(voxels, scale), exposed(voxels, scale)
    return v.join(a, "id").select("id", (math.pi ** (1 / 3) * F.pow(6 * F.col("volume"), F.lit(2 / 3)) / F.col("area")).alias("sphericity"))


def in_pieces(rows: DataFrame, by: str, one: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """one() of the rows of each value of `by`, which are one task's work. Small pieces share a group of about a million rows, since a group costs
    more than its rows do."""
    groups = max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.count() >> 20)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by, kind="stable")
        cut = np.flatnonzero(np.diff(pdf[by].to_numpy())) + 1
        return pd.concat([one(pdf.iloc[i:j]) for i, j in zip([0, *cut], [*cut, len(pdf)])])

    return rows.groupBy(F.pmod(F.xxhash64(by), F.lit(groups)).alias("group")).applyInPandas(run, schema)


def depths(voxels: DataFrame, scale: Scale = Scale(), flat: bool = False, by: str = "label") -> DataFrame:
    """Voxels with `depth`, their distance to the nearest place that does not belong to the same label (or other column `by`); in the plane with
    flat. Found line by line, so an object may be of any size."""
    rows = squared_depths(voxels, scale, ("y", "x") if flat else ("z", "y", "x"), by)
    return rows.select(*AT, "label", F.sqrt("d2").alias("depth"))


def radii(voxels: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """(id, radius): the greatest distance of an object's voxel to a place outside it."""
    return depths(voxels, scale).groupBy(F.col("label").alias("id")).agg(F.max("depth").alias("radius"))


def projection(image: DataFrame, method: str, depth: int, column: str = "value") -> DataFrame:
    """(y, x, value) over all layers, in which missing voxels are 0: max, min, mean, sum or (population) std."""
    s, q, n = F.sum(column), F.sum(F.col(column) * F.col(column)), F.count("*")
    value = {
        "max": F.greatest(F.max(column), F.when(n < depth, 0.0).otherwise(F.max(column))), "min": F.least(F.min(column), F.when(n < depth, 0.0).otherwise(F.min(column))),
        "sum": s, "mean": s / depth, "std": F.sqrt(F.greatest(F.lit(0.0), q / depth - (s / depth) * (s / depth))),
    }[method]
    return image.groupBy("y", "x").agg(value.cast("double").alias("value"))


# Morphology


def dilate(voxels: DataFrame, radius: float, shape: tuple[int, int, int], scale: Scale = Scale(), offsets: list | None = None) -> DataFrame:
    """Places within the radius of any voxel; or, for a few offsets, the voxels at each of them."""
    if offsets:
        return inside(shifted(voxels.select(*AT), offsets).distinct(), shape)
    return nearest(voxels.select(*AT, F.lit(0).alias("label")), radius, shape, scale).select(*AT)


def dilate_labels(voxels: DataFrame, radius: float, shape: tuple[int, int, int], scale: Scale = Scale()) -> DataFrame:
    """Labels grown into free places within the radius, each place to the nearest voxel's label, ties to the smaller."""
    return nearest(voxels, radius, shape, scale).select(*AT, "label")


def erode(voxels: DataFrame, radius: float, scale: Scale = Scale(), keep_labels: bool = False, flat: bool = False) -> DataFrame:
    """Voxels farther than the radius from every place outside, which is every place without a row, beyond the image too (with keep_labels also
    from every other label): pass a padded image to keep its border."""
    own = voxels if keep_labels else voxels.select(*AT).distinct().withColumn("label", F.lit(1))
    deep = squared_depths(own, scale, ("y", "x") if flat else ("z", "y", "x")).where(F.col("d2") > float(radius) * float(radius))
    return voxels.join(deep.select(*AT).distinct(), AT, "left_semi")


def spread_into(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """Every place of the mask with the label of the nearest voxel, ties to the smaller label."""
    from ..helpers import knn_join

    places = mask.select(*AT).distinct().withColumn("id", F.col("z").cast("long") * (1 << 42) + F.col("y").cast("long") * (1 << 21) + F.col("x").cast("long"))
    own = voxels.select(F.struct("label", *AT).alias("s"), *AT)
    key = F.col("s.label").cast("long") * (1 << 40) + (F.col("s.z").cast("long") * 16384 + F.col("s.y")) * 1024 + F.col("s.x")
    points = settle(own.select(key.alias("id"), *AT), "points")
    near = knn_join(places, points, 1, self_join=False)
    return places.join(near.select(F.col("q").alias("id"), F.shiftright("n", 40).alias("label")), "id").select(*AT, "label")


def skeleton_length(voxels: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """(id, length): distances between neighbouring voxels of a label, each pair once."""
    moved = shifted(voxels.select(*AT, F.col("label").alias("m")), HALF, scale)
    pairs = voxels.join(moved, AT).where("label = m").groupBy(F.col("label").alias("id")).agg(F.sum(F.sqrt("d2")).alias("length"))
    return voxels.select(F.col("label").alias("id")).distinct().join(pairs, "id", "left").select("id", F.coalesce("length", F.lit(0.0)).alias("length"))


def neighbour_counts(voxels: DataFrame, same_label: bool = True) -> DataFrame:
    """Voxels with n, how many of the 26 around belong to the same label (or to any)."""
    moved = shifted(voxels.select(*AT, F.col("label").alias("m")), AROUND)
    met = voxels.join(moved, AT).where(F.col("label") == F.col("m") if same_label else F.lit(True)).groupBy(*AT).agg(F.count("*").alias("n"))
    return voxels.join(met, AT, "left").select(*AT, "label", F.coalesce("n", F.lit(0)).alias("n"))


def branch_measures(voxels: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """(id, length, tortuosity): length over the greatest distance between ends (voxels with one neighbour; all, if there are fewer than two).
    A branch of one voxel has the length of its side and tortuosity 1."""
    length = skeleton_length(voxels, scale)
    n = neighbour_counts(voxels)
    per = n.groupBy("label").agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("ends"), F.count("*").alias("size"))
    ends = n.join(per, "label").where((F.col("n") == 1) | (F.col("ends") < 2)).select("label", *AT)
    span = spans(ends, scale).withColumnRenamed("label", "id")
    out = length.join(span, "id").join(per.select(F.col("label").alias("id"), "size"), "id")
    one = F.col("size") == 1
    return out.select("id", F.when(one, scale.xy).otherwise(F.col("length")).alias("length"), F.when(one, 1.0).otherwise(F.try_divide("length", "span")).alias("tortuosity"))


def boundary(voxels: DataFrame) -> DataFrame:
    """Voxels with a different label, or none, at one of their 26 neighbours."""
    rows = shifted(voxels.select(*AT, F.struct(*AT).alias("own"), F.col("label").alias("m")), AROUND)
    met = rows.join(voxels.select(*AT, "label"), AT, "left").where(F.col("label").isNull() | (F.col("label") != F.col("m"))).select("own.*").distinct()
    return voxels.join(met, AT, "left_semi")


def downsample(voxels: DataFrame, factor: int, depth: int) -> DataFrame:
    """Every factor-th voxel along the axes, with coordinates divided; layers are kept where there are fewer than four factors of them."""
    axes = AT if depth >= 4 * factor else AT[1:]
    rows = voxels.where(" AND ".join(f"{a} % {factor} = 0" for a in axes))
    return rows.select(*[(F.floor(F.col(a) / factor).cast("int") if a in axes else F.col(a)).alias(a) for a in AT], "label")


def upsample(voxels: DataFrame, factor: int, depth_too: bool = True) -> DataFrame:
    """Every voxel as a block of factor along the axes."""
    k = range(factor)
    block = [(dz, dy, dx) for dz in (k if depth_too else (0,)) for dy in k for dx in k]
    wide = voxels.select((F.col("z") * (factor if depth_too else 1)).alias("z"), (F.col("y") * factor).alias("y"), (F.col("x") * factor).alias("x"), "label")
    return shifted(wide, block)


def outer_edges(edges: DataFrame, region: DataFrame) -> DataFrame:
    return masked(edges, region, invert=True)


def inner_edges(edges: DataFrame, region: DataFrame) -> DataFrame:
    return masked(edges, boundary(region))


def fill_holes(voxels: DataFrame) -> DataFrame:
    """Places of a slice along any of the three axes that its foreground encloses, with the foreground: background that does not reach the
    slice's border over 4 neighbours. One slice is one task's work."""

    def of(axis: str) -> DataFrame:
        other = [a for a in AT if a != axis]

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            at = pdf[other].to_numpy()
            lo = at.min(0) - 1
            free = np.ones(at.max(0) - lo + 2, bool)
            free[tuple((at - lo).T)] = False
            out = np.zeros_like(free)
            out[0], out[-1], out[:, 0], out[:, -1] = free[0], free[-1], free[:, 0], free[:, -1]
            while True:
                more = out.copy()
                more[1:] |= out[:-1]
                more[:-1] |= out[1:]
                more[:, 1:] |= out[:, :-1]
                more[:, :-1] |= out[:, 1:]
                more &= free
                if (more == out).all():
                    break
                out = more
            hole = np.argwhere(free & ~out) + lo
            return pd.DataFrame({axis: np.full(len(hole), pdf[axis].iloc[0], np.int32), other[0]: hole[:, 0].astype(np.int32), other[1]: hole[:, 1].astype(np.int32)})[AT]

        return voxels.groupBy(axis).applyInPandas(one, "z int, y int, x int")

    return voxels.select(*AT).unionByName(of("z")).unionByName(of("y")).unionByName(of("x")).distinct()


def spilled(rows: DataFrame, by: str) -> DataFrame:
    """(z, y, x, label) of rows (z, y, x, height, seed, by) by a flood from the seeds, the lowest place first and of equal ones the one reached
    first, over shared faces; places that no seed reaches are left out. The rows of one value of `by` are one task's work."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(AT)
        at = list(zip(*(pdf[a].tolist() for a in AT)))
        place, height, label = {p: i for i, p in enumerate(at)}, pdf["height"].tolist(), pdf["seed"].tolist()
        heap = [(height[i], i, i) for i, v in enumerate(label) if v]
        heapq.heapify(heap)
        age = len(at)
        while heap:
            _, _, i = heapq.heappop(heap)
            z, y, x = at[i]
            for dz, dy, dx in FACES:
                j = place.get((z + dz, y + dy, x + dx))
                if j is not None and not label[j]:
                    label[j] = label[i]
                    heapq.heappush(heap, (height[j], age, j))
                    age += 1
        return pdf[AT].assign(label=label).query("label > 0")

    return in_pieces(rows, by, one, "z int, y int, x int, label long")


def flood(voxels: DataFrame, share: float = 0.1, scale: Scale = Scale(), smallest: float | None = None, flat: bool = False) -> DataFrame:
    """Binary watershed: of the image's different depths the one at `share` of their order (or `smallest`, a radius) parts the deep places, whose
    connected pieces are seeds, and the rest is flooded from them, deep places first. Components without a deep place are left out. Labels
    are the numbers of the seeds."""
    deep = settle(depths(connected(voxels), scale, flat), "depths")
    top = deep.where(F.col("depth") > smallest) if smallest is not None else above_share(deep, share, "depth")
    seeds = settle(connected(top).withColumnRenamed("label", "seed"), "seeds")
    rows = deep.join(seeds, AT, "left").select(*AT, "label", (-F.col("depth")).alias("height"), F.coalesce("seed", F.lit(0)).alias("seed"))
    return spilled(rows, "label")


def _key(at: np.ndarray) -> np.ndarray:
    """A number for each place, from 1 on along each axis, such that neighbours differ by the same everywhere."""
    return (at[:, 0] << 42) + (at[:, 1] << 21) + at[:, 2]


_SPOTS = np.array(list(product((-1, 0, 1), repeat=3)))
_GAPS = np.abs(_SPOTS[:, None] - _SPOTS[None])
_TOUCH, _SHARE = (_GAPS.max(2) == 1), (_GAPS.sum(2) == 1)
_RING = np.abs(_SPOTS).sum(1) > 0
_NEAR = _RING & (np.abs(_SPOTS).sum(1) < 3)
_FACE = np.abs(_SPOTS).sum(1) == 1


def _pieces(cells: np.ndarray, linked: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """How many connected pieces of each row's cells hold a counted place."""
    name = np.where(cells, np.arange(27, dtype=np.int8), np.int8(27))
    while True:
        low = name.copy()
        for i in range(27):
            low[:, i] = np.minimum(name[:, i], name[:, linked[i]].min(1))
        low = np.where(cells, low, np.int8(27))
        if (low == name).all():
            break
        name = low
    seen = np.zeros((len(cells), 28), bool)
    rows, spots = np.nonzero(cells & counted)
    seen[rows, name[rows, spots]] = True
    return seen[:, :27].sum(1)


def removable(patch: np.ndarray) -> np.ndarray:
    """True for places (rows of 27) that are no ends and whose removal keeps what touches them in one piece and what is free around them in one."""
    own, free = patch & _RING, ~patch & _NEAR
    ok = own.sum(1) > 1
    ok[ok] = _pieces(own[ok], _TOUCH, _RING) == 1
    ok[ok] = _pieces(free[ok], _SHARE, _FACE) == 1
    return ok


def thin(voxels: DataFrame) -> DataFrame:
    """A skeleton of each component: voxels are peeled from the six sides in turn as long as their 26 neighbours stay one piece, the places
    around stay one piece, and they are no ends. Of a side's voxels those that do not touch one another (every other one along each axis)
    go at once, so that what one loses does not change what another may. One component is one task's work, of some 100 bytes a voxel."""

    steps = _key(_SPOTS.astype(np.int64))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # components do not touch, so those of a group are thinned side by side
        at = pdf[AT].to_numpy(np.int64)
        low = at.min(0) - 1
        at = at - low
        order = np.argsort(_key(at))
        at, label, changed = at[order], pdf["label"].to_numpy()[order], True
        keys = _key(at)
        here, place = np.ones(len(at), bool), lambda k: np.minimum(np.searchsorted(keys, k), len(keys) - 1)

        def there(k: np.ndarray) -> np.ndarray:
            i = place(k)
            return (keys[i] == k) & here[i]

        while changed:
            changed = False
            for f in FACES:
                rim = here & ~there(keys + _key(np.array([f]))[0])
                for odd in product((0, 1), repeat=3):
                    some = np.flatnonzero(rim & (at % 2 == odd).all(1))
                    if len(some):
                        gone = some[removable(there((keys[some][:, None] + steps).ravel()).reshape(-1, 27))]
                        here[gone] = False
                        changed |= bool(len(gone))
        left = at[here] + low
        return pd.DataFrame({"z": left[:, 0], "y": left[:, 1], "x": left[:, 2], "label": label[here]})

    rows = settle(connected(voxels), "components")
    groups = max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.count() >> 20)
    return rows.groupBy(F.pmod(F.xxhash64("label"), F.lit(groups)).alias("group")).applyInPandas(run, "z int, y int, x int, label long")


def branch_points(skeleton: DataFrame) -> DataFrame:
    """Skeleton voxels with more than two neighbours, of which more than two pieces do not touch by a face."""
    spot = lambda o: sum((o[i] + 1) * 3 ** (2 - i) for i in range(3))
    here = skeleton.select(*AT).distinct()
    near = here.select(F.struct(*AT).alias("from"), F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for v, a in zip(o, AT)], F.lit(spot(o)).alias("spot")) for o in AROUND])).alias("o"))
    near = near.select("from", "o.spot", *[(F.col(f"from.{a}") + F.col(f"o.d{a}")).alias(a) for a in AT]).join(here, AT)
    near = near.groupBy("from").agg(F.collect_list("spot").alias("near"))

    @F.pandas_udf("int")
    def pieces(column: pd.Series) -> pd.Series:
        cells = np.zeros((len(column), 27), bool)
        for i, spots in enumerate(column):
            cells[i, spots] = True
        return pd.Series(_pieces(cells, _SHARE, _RING))

    return near.where(F.size("near") > 2).where(pieces("near") > 2).select("from.*")


def branches(voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Labels of branches: skeleton pieces between branch points, spread over all voxels."""
    bones = settle(thin(voxels), "skeleton")
    joints = settle(dilate(branch_points(bones), 1, shape, offsets=box((3, 3, 3))), "joints")
    pieces = settle(connected(masked(bones, joints, invert=True)), "pieces")
    return spread_into(pieces, voxels)


def trimmed_branches(skeleton: DataFrame, least: int) -> DataFrame:
    """Without terminal branches of fewer than `least` voxels: pieces between branch points that hold an end of the skeleton."""
    joints = branch_points(skeleton)
    rest = connected(masked(skeleton, joints, invert=True))
    ends = neighbour_counts(skeleton.withColumn("label", F.lit(1)), False).where("n = 1").select(*AT)
    short = rest.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") < least).select("label")
    gone = rest.join(short, "label", "left_semi").join(rest.join(ends, AT, "left_semi").select("label").distinct(), "label", "left_semi")
    return skeleton.join(gone.select(*AT), AT, "left_anti")


def smoothed(image: DataFrame, shape: tuple[int, int, int], sigma: float = 1.0, column: str = "value") -> DataFrame:
    """Gaussian smoothing over four deviations, with zero beyond the image."""
    n = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    k /= k.sum()
    out = image.select(*AT, F.col(column).cast("double").alias("value"))
    for axis, size in zip(AT, shape):
        if size == 1:
            continue
        taps = F.array(*[F.struct(F.lit(i - n).alias("d"), F.lit(float(w)).alias("w")) for i, w in enumerate(k)])
        rows = out.select(*AT, "value", F.explode(taps).alias("t")).select(*[(F.col(a) + F.col("t.d")).alias(a) if a == axis else F.col(a) for a in AT], (F.col("value") * F.col("t.w")).alias("value"))
        out = rows.where((F.col(axis) >= 0) & (F.col(axis) < size)).groupBy(*AT).agg(F.sum("value").alias("value"))
    return out


def lines(pairs: DataFrame) -> DataFrame:
    """Voxels of value 255 on straight lines between places a and b: as many steps as the longest axis, rounded."""
    n = F.greatest(*[F.abs(F.col(f"b.{a}") - F.col(f"a.{a}")) for a in AT])
    rows = pairs.select("a", "b", n.alias("n")).select("*", F.explode(F.sequence(F.lit(0), "n")).alias("i"))
    at = [F.rint(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * F.coalesce(F.try_divide("i", "n"), F.lit(0.0))).cast("int").alias(c) for c in AT]
    return rows.select(*at).distinct().withColumn("value", F.lit(255))


def grey_codes(labels: DataFrame, top: int = 255) -> DataFrame:
    """(id, grey): labels in order, spread evenly over 1..top."""
    from .ranks import numbered

    rows = numbered(labels.select("id").distinct(), "id", start=1, name="i")
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).select("id", F.rint(F.col("i") * top / F.col("n")).cast("int").alias("grey"))


# Joins of images


def through_edges(nodes: DataFrame, edges: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(edge, node): edge objects that a node grown by one voxel touches."""
    grown = inside(shifted(nodes.select(*AT, F.col("label").alias("node")), box((3, 3, 3))), shape)
    return edges.select(*AT, F.col("label").alias("edge")).join(grown, AT).select("edge", "node").distinct()


def touching(nodes: DataFrame, radius: float, scale: Scale = Scale()) -> DataFrame:
    """Pairs of labels with voxels at a distance of at most the radius; only boundary voxels are compared."""
    rim = settle(boundary(nodes), "rim")
    pairs = grid_join(rim, rim, radius, scale).where("l.label < r.label")
    return pairs.select(F.col("l.label").alias("node_a"), F.col("r.label").alias("node_b")).distinct().withColumn("edge_c", F.lit(0).cast("long"))


def adjacent(nodes: DataFrame) -> DataFrame:
    """Pairs of labels that share a face."""
    moved = shifted(nodes.select(*AT, F.col("label").alias("m")), [(0, 0, 1), (0, 1, 0), (1, 0, 0)])
    return nodes.join(moved, AT).where("label <> m").select(F.least("label", "m").alias("node_a"), F.greatest("label", "m").alias("node_b")).distinct().withColumn("edge_c", F.lit(0).cast("long"))


def border_distance(nodes: DataFrame, roots: DataFrame, targets: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """(id, dist): the least distance between boundary voxels of a root and of another target; equal places are skipped."""
    rim = settle(boundary(nodes).withColumn("key", F.xxhash64(*AT, "label")), "rim")
    r = rim.join(roots.select(F.col("id").alias("label")), "label", "left_semi")
    out = None
    t = rim.join(targets.select(F.col("id").alias("label")), "label", "left_semi")
    reach = 2.0 * scale.least
    far = (rim.agg(*[(F.max(a) - F.min(a)).alias(a) for a in AT]).first() or (0, 0, 0))
    whole = math.sqrt(sum(((far[i] or 0) * (scale.z if i == 0 else scale.xy)) ** 2 for i in range(3))) + 1
    todo = r
    while True:
        near = grid_join(todo, t, min(reach, whole), scale).where("l.label <> r.label AND d2 > 0")
        found = settle(near.groupBy(F.col("l.label").alias("id")).agg(F.sqrt(F.min("d2")).alias("dist")), "found")
        out = found if out is None else out.unionByName(found)
        todo = settle(todo.join(found.select(F.col("id").alias("label")), "label", "left_anti"), "todo")
        if reach >= whole or todo.isEmpty():
            break
        reach *= 2
    return roots.select("id").distinct().join(out, "id", "left")


def look_up(voxels: DataFrame, values: DataFrame) -> DataFrame:
    """The image of a number for each label; labels without one are 0."""
    return voxels.join(values.select(F.col("id").alias("label"), "value"), "label", "left").select(*AT, F.coalesce("value", F.lit(0)).alias("value"))


def channel_identities(nodes: DataFrame, channels: dict[str, DataFrame], negatives: bool = False) -> DataFrame:
    """(id, ids): `name+` for every channel that has a voxel in the node, and `name-` for the others if wanted."""
    ids = nodes.select(F.col("label").alias("id")).distinct()
    hits = None
    for name, mask in channels.items():
        has = nodes.join(mask.select(*AT).distinct(), AT, "left_semi").select(F.col("label").alias("id")).distinct().select("id", F.lit(name).alias("name"))
        hits = has if hits is None else hits.unionByName(has)
    found = hits.groupBy("id").agg(F.collect_set("name").alias("found"))
    plus = F.array(*[F.when(F.array_contains(F.coalesce("found", F.array().cast("array<string>")), n), n + "+").otherwise(F.lit(n + "-" if negatives else None)) for n in channels])
    return ids.join(found, "id", "left").select("id", F.array_compact(plus).alias("ids"))


def intensities(nodes: DataFrame, channels: dict[str, DataFrame]) -> DataFrame:
    """A row for each node with the mean of each channel's positive values in it, 0 where there is none."""
    out = nodes.select(F.col("label").alias("id")).distinct()
    for name, image in channels.items():
        mean = nodes.join(image.where("value > 0"), AT).groupBy(F.col("label").alias("id")).agg(F.avg("value").alias(name))
        out = out.join(mean, "id", "left")
    return out.na.fill(0.0)


def overlaid(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first image's labels, and where it has none those of the second, moved behind the first's greatest."""
    top = F.broadcast(first.agg(F.coalesce(F.max("label"), F.lit(0)).alias("top")))
    both = first.select(*AT, F.col("label").alias("a")).join(second.select(*AT, F.col("label").alias("b")), AT, "full").crossJoin(top)
    return both.select(*AT, F.coalesce("a", F.col("b") + F.col("top")).alias("label"))


def edge_in_shell(nodes: DataFrame, edges: DataFrame, radius: float, shape: tuple[int, int, int], scale: Scale = Scale(), core: bool = False) -> DataFrame:
    """(id, volume): edge voxels within the radius of a node, those in the node itself too if core is set."""
    grown = nearest(nodes, radius, shape, scale, each=True).select(*AT, F.col("label").alias("id"))
    if not core:
        grown = grown.join(nodes.select(*AT, F.col("label").alias("id")), [*AT, "id"], "left_anti")
    hit = grown.join(edges.select(*AT).distinct(), AT).groupBy("id").agg((F.count("*") * (scale.xy * scale.xy * scale.z)).alias("volume"))
    return nodes.select(F.col("label").alias("id")).distinct().join(hit, "id", "left").select("id", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def shell_identities(nodes: DataFrame, identities: DataFrame, root: str, radius: float, shape: tuple[int, int, int]) -> DataFrame:
    """(identity, volume, total, density): voxels of each identity within the radius of the root identity's nodes but not in them, over all
    of its voxels."""
    rows = nodes.join(identities.select(F.col("id").alias("label"), "ids"), "label")
    core = rows.where(F.array_contains("ids", root)).select(*AT)
    shell = dilate(core, radius, shape).join(core, AT, "left_anti")
    each = rows.select(*AT, F.explode("ids").alias("identity"))
    total = each.groupBy("identity").agg(F.count("*").alias("total"))
    found = each.join(shell, AT, "left_semi").groupBy("identity").agg(F.count("*").alias("volume"))
    return total.join(found, "identity", "left").select("identity", F.coalesce("volume", F.lit(0)).alias("volume"), "total", (F.coalesce("volume", F.lit(0)) / F.col("total")).alias("density"))


def peaks_filter(voxels: DataFrame, peak: int = 1, bins: int = 20) -> DataFrame:
    """Components larger than the valley behind the given peak of the histogram of their sizes (on a log scale); all if there is none."""
    c = connected(voxels)
    sizes = c.groupBy("label").agg(F.count("*").alias("n"))
    lo, hi = sizes.agg(F.log(F.min("n")), F.log(F.max("n"))).first()
    if lo is None or lo == hi:
        return c
    at = F.least(F.lit(bins - 1), F.floor((F.log("n") - lo) / ((hi - lo) / bins))).cast("int")
    h = np.zeros(bins)
    for r in sizes.groupBy(at.alias("b")).agg(F.count("*").alias("k")).collect():  # a row for each bin
        h[r.b] = r.k
    tops = [i for i in range(bins) if h[i] > 0 and (i == 0 or h[i] >= h[i - 1]) and (i == bins - 1 or h[i] > h[i + 1])]
    if len(tops) <= peak:
        return c
    valley = tops[peak - 1] + int(np.argmin(h[tops[peak - 1] : tops[peak] + 1]))
    keep = sizes.where(F.log("n") > lo + valley * (hi - lo) / bins).select("label")
    return c.join(keep, "label", "left_semi").select(*AT, "label")

