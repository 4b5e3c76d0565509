"""Clustering of rows of features and of points."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..helpers import components, knn_join, settle
from .ranks import numbered


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df.na.fill(0.0, features))


def kmeans(df: DataFrame, features: list[str], k: int, starts: int = 10, seed: int = 42) -> DataFrame:
    """df with `cluster`, 1..k by size: the best by cost of several starts with seeds in turn."""
    rows = settle(_vectors(df, features), "features")
    models = [KMeans(k=k, seed=seed + i, initSteps=2).fit(rows) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    out = best.transform(rows).drop("features")
    sizes = out.groupBy("prediction").agg(F.count("*").alias("n"))
    rank = sizes.select("prediction", F.row_number().over(Window.orderBy(F.desc("n"), "prediction")).alias("cluster"))
    return out.join(F.broadcast(rank), "prediction").drop("prediction")


def calinski_harabasz(df: DataFrame, features: list[str], cluster: str = "cluster") -> float:
    """Spread between clusters over spread within, each over its degrees of freedom."""
    whole = df.agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features]).first()
    per = df.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features], *[(F.var_pop(f) * F.count("*")).alias(f"w_{f}") for f in features]).collect()  # a row for each cluster
    k = len(per)
    between = sum(r["n"] * sum((r[f] - whole[f]) ** 2 for f in features) for r in per)
    within = sum(r[f"w_{f}"] for r in per for f in features)
    return between / (k - 1) / (within / (whole["n"] - k)) if k > 1 and within else 0.0


def auto_kmeans(df: DataFrame, features: list[str], most: int = 20, seed: int = 42, starts: int = 1) -> DataFrame:
    """kmeans with the k from 2 to a third of the rows (20 at most) of the greatest Calinski-Harabasz score."""
    n = df.count()
    best = None
    for k in range(2, max(3, min(n // 3, n - 1, most) + 1)):
        out = kmeans(df, features, k, starts, seed)
        score = calinski_harabasz(out, features)
        if best is None or score > best[0]:
            best = (score, out)
    return best[1]


def dbscan_settings(points: DataFrame, axes=("z", "y", "x")) -> tuple[float, int]:
    """(eps, least): the 80th percentile of the distance to the k-th neighbour, k the smaller of 4 and n - 1, and a fifth of the root of n, at
    least 3."""
    n = points.count()
    k = min(4, n - 1)
    far = knn_join(points, points, k, axes=axes).where(F.col("rank") == k)
    return far.agg(F.percentile(F.sqrt("d2"), F.lit(0.8))).first()[0], max(3, int(0.2 * n**0.5))


#: Places of a chunk of a cell, about, and pairs of places that are in memory at a time, unless two chunks have more.
CHUNK, PAIRS = 256, 1 << 20
#: Cells along an axis, so that three of their numbers fit one of 64 bits.
CELLS = 1 << 20


def _chunked(places: DataFrame, axes: tuple[str, ...], more: list[str]) -> DataFrame:
    """(cell, chunk, axes and more as lists): the places of each cell of `size` places, dealt by hash into chunks of at most about CHUNK."""
    rows = places.withColumn("chunk", F.pmod(F.xxhash64(*axes), F.ceil(F.col("size") / CHUNK)))
    each = F.sort_array(F.collect_list(F.struct(*axes, *more)))
    rows = rows.groupBy("cell", "chunk").agg(each.alias("p"))
    return rows.select("cell", "chunk", *[F.col(f"p.{c}").alias(c) for c in (*axes, *more)])


class _Pairs:
    """The pairs of points of chunks that meet: columns of both sides as flat arrays, the places of each pair in them, and its squared distance. Pairs
    of a point of a stand together, and so do those of a row of chunks."""

    def __init__(self, rows: pa.RecordBatch, na: np.ndarray, nb: np.ndarray, axes: tuple[str, ...]):
        self.at = {n: c.flatten().to_numpy() for n, c in zip(rows.schema.names, rows.columns)}
        each = np.repeat(nb, na)  # pairs of each point of a
        self.begin = np.cumsum(each) - each
        self.first_a, self.first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        self.row = np.cumsum(na * nb) - na * nb
        self.a = np.repeat(np.arange(len(each)), each)
        self.b = np.arange(int(each.sum())) + np.repeat(np.repeat(self.first_b, na) - self.begin, each)
        self.each, self.d2 = each, None
        for x in axes:
            d = self.at[f"{x}_a"][self.a].astype(float) - self.at[f"{x}_b"][self.b].astype(float)
            self.d2 = d * d if self.d2 is None else self.d2 + d * d


def _beside(a: DataFrame, b: DataFrame, axes: tuple[str, ...], one, schema: str, half: bool = False) -> DataFrame:
    """one(pairs) of the chunks of a and b in cells that may hold points within the radius of each other; with half of each two cells only once, and
    of no cell with itself. Keys meet first, their places then."""
    n = len(axes)
    offsets = [o for o in product(range(-2, 3), repeat=n) if sum(max(abs(d) - 1, 0) ** 2 for d in o) <= n and (not half or o > (0,) * n)]
    shift = F.explode(F.array(*[F.lit(sum(d * CELLS**i for i, d in enumerate(o))).cast("long") for o in offsets]))
    moved = a.select(F.col("cell").alias("cell_a"), F.col("chunk").alias("chunk_a"), shift.alias("o"))
    moved = moved.select("cell_a", "chunk_a", (F.col("cell_a") + F.col("o")).alias("cell_b"))
    named = lambda df, w: df.select(*[F.col(c).alias(f"{c}_{w}") for c in df.columns])
    a, b = named(a, "a"), named(b, "b")
    met = moved.join(b.select("cell_b", "chunk_b"), "cell_b").join(a, ["cell_a", "chunk_a"]).join(b, ["cell_b", "chunk_b"]).drop("cell_a", "cell_b", "chunk_a", "chunk_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            na, nb = (batch.column(f"{axes[0]}_{w}").value_lengths().to_numpy().astype(np.int64) for w in "ab")
            cut = np.flatnonzero(np.diff(np.cumsum(na * nb) // PAIRS)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(na)]):
                if lo < hi:
                    found = one(_Pairs(batch.slice(lo, hi - lo), na[lo:hi], nb[lo:hi], axes))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, found)], names)

    return met.mapInArrow(run, schema)


def dbscan(points: DataFrame, eps: float, least: int, axes=("z", "y", "x")) -> DataFrame:
    """(id, cluster): points with at least `least` points within eps, themselves included, are cores; linked cores are a cluster, and other
    points join the cluster of their nearest core within eps, ties by id. The rest is 0. Clusters are numbered by their least core.

    Points of one place are one row with a weight. Cells of a grid are so small that the points of one are within eps of each other: a cell of
    `least` points has cores only, and the cores of a cell are one node of the graph whose components are clusters. Chunks of neighbouring cells
    are compared in numpy, for counts, for links of cells and for nearest cores, so that no pair of points is ever a row."""
    axes, limit = tuple(axes), float(eps) * float(eps)
    side = float(eps) / len(axes) ** 0.5
    low = points.agg(*[f(a) for a in axes for f in (F.min, F.max)]).first()
    if low[0] is not None and (len(axes) > 3 or any((low[2 * i + 1] - low[2 * i]) / side >= CELLS - 8 for i in range(len(axes)))):
        raise ValueError(f"up to three axes of up to {CELLS} cells")
    # the number of a cell, with room for two cells around all others
    cell = sum(((F.floor(F.col(a) / F.lit(side)) - F.lit(math.floor((low[2 * i] or 0) / side) - 4)).cast("long") * CELLS**i for i, a in enumerate(axes)), F.lit(0).cast("long"))
    places = points.groupBy(*axes).agg(F.count("*").alias("n"), F.min("id").cast("long").alias("id")).withColumn("cell", cell)
    cells = places.groupBy("cell").agg(F.count("*").alias("size"), F.sum("n").alias("all"))
    places = settle(places.join(cells, "cell"), "places")
    dense, few = places.where(F.col("all") >= least), places.where(F.col("all") < least)
    sparse, every = settle(_chunked(few, axes, ["id"]), "sparse"), settle(_chunked(places, axes, ["n"]), "chunks")

    def counted(p: _Pairs):
        return p.at["id_a"], np.add.reduceat((p.d2 <= limit) * p.at["n_b"][p.b], p.begin)

    enough = _beside(sparse, every, axes, counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("id")
    cores = dense.unionByName(few.join(enough, "id", "left_semi"))
    cores = settle(cores.withColumn("node", F.min("id").over(Window.partitionBy("cell"))), "cores")
    own = settle(_chunked(cores, axes, ["id", "node"]), "core-chunks")

    def linked(p: _Pairs):
        some = np.logical_or.reduceat(p.d2 <= limit, p.row)
        return p.at["node_a"][p.first_a[some]], p.at["node_b"][p.first_b[some]]

    links = _beside(own, own, axes, linked, "a long, b long", half=True).distinct()
    parts = components(links, "a", "b")
    named = cores.select("node").distinct().join(parts.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    names = numbered(named.select("component").distinct(), "component", start=1, name="cluster").select("component", F.col("cluster").cast("long").alias("cluster"))
    clusters = settle(named.join(names, "component").select("node", "cluster"), "clusters")

    def nearest(p: _Pairs):
        low, ids = np.minimum.reduceat(p.d2, p.begin), p.at["id_b"][p.b]
        ids = np.where(p.d2 == np.repeat(low, p.each), ids, np.iinfo(np.int64).max)
        least = np.minimum.reduceat(ids, p.begin)
        at = np.minimum.reduceat(np.where(ids == np.repeat(least, p.each), np.arange(len(ids)), len(ids)), p.begin)
        near = low <= limit
        return p.at["id_a"][near], low[near], least[near], p.at["node_b"][p.b[at[near]]]

    others = settle(_chunked(few.join(cores.select("id"), "id", "left_anti"), axes, ["id"]), "others")
    near = _beside(others, own, axes, nearest, "id long, d2 double, b long, node long").groupBy("id").agg(F.min_by("node", F.struct("d2", "b")).alias("node"))
    joined = settle(cores.select("id", "node").unionByName(near), "joined").join(clusters, "node").select("id", "cluster")
    by_place = places.join(joined, "id").select(*axes, "cluster")
    return points.select("id", *axes).join(by_place, list(axes), "left").select("id", F.coalesce("cluster", F.lit(0)).alias("cluster"))
