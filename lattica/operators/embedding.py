"""Maps of vectors in the plane that keep neighbours together: a fuzzy graph of nearest neighbours, laid out by gradient rounds.

Equal vectors are one point, so that a place that very many rows share is no hub: a point is among the k nearest of at most k times the kissing
number of its dimension, however many points there are, and with that what a round gathers for a point has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..helpers import settle
from .ranks import numbered

#: The curve 1 / (1 + A d^(2 B)) of likeness in the map, for points that may be 0.1 apart at most without losing it. Fixed values.
A, B = 1.5769434603, 0.8950608779
#: Points of a stretch of a projection that are compared with each other, and points that a point is pushed from in a round.
STRETCH, PUSHED = 64, 20


def _spread(df: DataFrame) -> DataFrame:
    """df, which has a row for each point, to be joined by a shuffle at any size: copies for every task of every round would pass through the driver."""
    return df.hint("merge")


def _best(vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, other, distance) of each point's k nearest others among the given ones."""
    d = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    k = min(k, len(ids) - 1)
    near = np.argsort(d, 1, kind="stable")[:, :k]
    return np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel()


def _compared(rows: DataFrame, k: int) -> DataFrame:
    """(i, j, d): the k nearest others of each point within every group of rows (group, i, v); groups are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            group = now.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(group)) + 1
            if len(cut):
                yield out(now.slice(0, cut[-1]))
            held = now.slice(cut[-1] if len(cut) else 0)
        if held is not None and len(held):
            yield out(held)

    def out(rows: pa.RecordBatch) -> pa.RecordBatch:
        group, ids = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        v = rows.column(2).flatten().to_numpy().reshape(len(rows), -1)
        found = [_best(v[g], ids[g], k) for g in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(group)) + 1)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["i", "j", "d"])

    return rows.repartition("group").sortWithinPartitions("group", "i").mapInArrow(run, "i long, j long, d double")


def _nearest_of(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("i").orderBy("d", "j")
    return pairs.groupBy("i", "j").agg(F.min("d").alias("d")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def nearest_vectors(points: DataFrame, k: int, projections: int = 10, rounds: int = 2, seed: int = 42) -> DataFrame:
    """(i, j, d): about the k nearest others of each point (i, v), v being arrays of one length.

    Points are put in the order of a random projection and each is compared with those of its stretch and the next, for several projections; then, in
    each round, the neighbours of every point are compared with one another. Stretches have a fixed number of points and lists have k, so no
    group grows with the data. Tests measure a recall above 0.9."""
    width = points.select(F.size("v").alias("n")).first()
    if width is None:
        return points.sparkSession.createDataFrame([], "i long, j long, d double")
    if points.count() <= STRETCH:
        projections, rounds = 1, 0  # one stretch holds all, and all are compared
    rng, found = np.random.default_rng(seed), None
    for _ in range(projections):
        way = F.array(*[F.lit(float(x)) for x in rng.standard_normal(width.n)])
        at = F.aggregate(F.zip_with("v", way, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        ranked = numbered(points.withColumn("at", at), "at", "i", name="rank").select("i", "v", F.floor(F.col("rank") / STRETCH).alias("stretch"))
        near = _compared(ranked.select(F.explode(F.array(F.col("stretch"), F.col("stretch") - 1)).alias("group"), "i", "v"), k)
        found = near if found is None else found.unionByName(near)
    best = settle(_nearest_of(found, k), "neighbours")
    for _ in range(rounds):
        lists = best.select(F.col("i").alias("group"), F.col("j").alias("i")).unionByName(points.select(F.col("i").alias("group"), "i"))
        best = settle(_nearest_of(best.unionByName(_compared(lists.join(_spread(points), "i").select("group", "i", "v"), k)), k), "neighbours")
    return best


def fuzzy_graph(near: DataFrame, k: int) -> DataFrame:
    """(i, j, w), both ways: how surely two points are neighbours. Each point's own view is exp(-(d - nearest) / width), its width found by bisection
    so that its k views sum to log2(k); a pair is surely linked unless neither end says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).value_lengths().to_numpy()
            if not len(n):
                continue
            d = np.full((len(n), n.max()), np.inf)
            d[np.arange(n.max()) < n[:, None]] = batch.column(1).flatten().to_numpy()
            over = np.maximum(d - d.min(1, keepdims=True), 0)
            lo, hi = np.zeros(len(n)), np.where(np.isfinite(d), d, 0).max(1) * 1000 + 1e-9
            for _ in range(64):
                width = (lo + hi) / 2
                wide = np.exp(-over / np.maximum(width, 1e-300)[:, None]).sum(1) > np.log2(max(k, 2))
                lo, hi = np.where(wide, lo, width), np.where(wide, width, hi)
            mean = np.where(np.isfinite(d), d, 0).sum(1) / n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d.min(1)), pa.array(np.maximum((lo + hi) / 2, 1e-3 * mean + 1e-12))], ["i", "nearest", "width"])

    lists = near.groupBy("i").agg(F.sort_array(F.collect_list("d")).alias("d"))  # k of them
    widths = lists.mapInArrow(run, "i long, nearest double, width double")
    own = near.join(_spread(widths), "i").select("i", "j", F.exp(-F.greatest(F.col("d") - F.col("nearest"), F.lit(0.0)) / F.col("width")).alias("p"))
    both = own.unionByName(own.select(F.col("j").alias("i"), F.col("i").alias("j"), "p"))
    return both.groupBy("i", "j").agg((1 - F.product(1 - F.col("p"))).alias("w"))


def _moved(pdf_batches: Iterator[pa.RecordBatch], rate: float, steps: int, dims: int) -> Iterator[pa.RecordBatch]:
    """Points after some steps down their gradients, while all others stay: pulled by what they are linked to, pushed from a few others."""
    for batch in pdf_batches:
        n = len(batch)
        x = batch.column(1).flatten().to_numpy().reshape(n, dims).copy()
        sides = []
        for c in (2, 4):
            count = batch.column(c).value_lengths().fill_null(0).to_numpy()
            row = np.repeat(np.arange(n), count)
            sides.append((row, batch.column(c).flatten().to_numpy(), batch.column(c + 1).flatten().flatten().to_numpy().reshape(len(row), dims)))
        total = np.bincount(sides[0][0], sides[0][1], n)
        for step in range(steps):
            force = np.zeros((n, dims))
            for pull, (row, w, other) in zip((True, False), sides):
                away = x[row] - other
                d2 = (away**2).sum(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    f = np.where(d2 > 0, -2 * A * B * d2 ** (B - 1) / (1 + A * d2**B), 0) if pull else 2 * B / ((0.001 + d2) * (1 + A * d2**B))
                f = np.clip(f[:, None] * away, -4, 4) * w[:, None]
                for a in range(dims):
                    force[:, a] += np.bincount(row, f[:, a], n)
            # links share a pull of 1, and pushes weigh five times as much, as if each link drew five points
            x += rate * (1 - step / (2 * steps)) * force / np.maximum(total, 1e-9)[:, None]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["i", "x"])


def laid_out(links: DataFrame, start: DataFrame, n: int, rounds: int = 12, steps: int = 10, dims: int = 2) -> DataFrame:
    """(i, x) of points 0 to n - 1 after gradient rounds from the places of start (i, x). A round joins the links with the places of their ends and
    every point with the places of PUSHED others, drawn by a hash of point, round and draw, so that reruns agree."""
    links, places = settle(links, "links"), start
    total = settle(links.groupBy("i").agg(F.sum("w").alias("total")), "totals")
    for turn in range(rounds):
        pulled = links.join(_spread(places.withColumnRenamed("i", "j")), "j").groupBy("i").agg(F.collect_list(F.struct("w", "x")).alias("p"))
        draw = places.select("i", F.explode(F.sequence(F.lit(1), F.lit(PUSHED))).alias("s")).select("i", F.pmod(F.xxhash64("i", "s", F.lit(turn)), F.lit(n)).alias("j")).where("i <> j")
        pushed = draw.join(_spread(places.withColumnRenamed("i", "j")), "j").join(_spread(total), "i").groupBy("i").agg(F.collect_list(F.struct((5 * F.col("total") / PUSHED).alias("w"), "x")).alias("q"))
        rows = places.join(_spread(pulled), "i", "left").join(_spread(pushed), "i", "left")
        # in a fixed order, so that sums do not depend on the shuffle
        rows = rows.select("i", "x", *[F.sort_array(c).getField(f).alias(f"{c}{f}") for c in "pq" for f in ("w", "x")])
        rows = rows.select("i", "x", *[F.coalesce(c, F.array().cast("array<double>" if c[1] == "w" else "array<array<double>>")).alias(c) for c in ("pw", "px", "qw", "qx")])
        rate = 1.0 - turn / rounds
        places = settle(rows.mapInArrow(lambda batches, rate=rate: _moved(batches, rate, steps, dims), "i long, x array<double>"), "places")
    return places


def embed(df: DataFrame, features: list[str], dims: int = 2, k: int = 15, rounds: int = 12) -> DataFrame:
    """df with `embedding`, an array of `dims` numbers: equal rows of features have equal ones. Null features count as 0. It begins with the
    principal components, at most 10 from the middle, and reruns agree. One distinct row is at 0."""
    vector = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    rows = df.withColumn("_v", vector)
    points = settle(numbered(rows.select(F.col("_v").alias("v")).distinct(), "v", name="i").select("i", "v"), "points")
    n = points.count()
    if n < 3:
        x = F.array(F.col("i").cast("double"), *[F.lit(0.0)] * (dims - 1))
        return rows.join(points.select(F.col("v").alias("_v"), x.alias("embedding")), "_v").drop("_v")
    own, parts = points.withColumn("f", array_to_vector("v")), min(dims, len(features))
    start = PCA(k=parts, inputCol="f", outputCol="p").fit(own).transform(own).select("i", vector_to_array("p").alias("p"))
    means = start.agg(*[F.avg(F.col("p")[c]).alias(f"m{c}") for c in range(parts)]).first()
    centred = start.select("i", F.array(*[F.col("p")[c] - float(means[c]) for c in range(parts)]).alias("p"))
    far = centred.agg(F.max(F.array_max(F.transform("p", lambda x: F.abs(x))))).first()[0] or 1.0
    # a hash of the point sets equal projections apart
    shake = lambda c: (F.pmod(F.xxhash64("i", F.lit(c)), F.lit(1000)) - 500) / 5e6
    start = settle(centred.select("i", F.array(*[(F.col("p")[c] * (10 / far) if c < parts else F.lit(0.0)) + shake(c) for c in range(dims)]).alias("x")), "start")
    k = min(k, n - 1)
    out = laid_out(fuzzy_graph(nearest_vectors(points, k), k), start, n, rounds, dims=dims)
    return rows.join(_spread(points.join(_spread(out), "i").select(F.col("v").alias("_v"), F.col("x").alias("embedding"))), "_v").drop("_v")
