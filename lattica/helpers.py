"""Building blocks of many operators: shared folders, fixpoint loops, and joins by distance."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import Scale


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, with the scheme of the file system that it is in. Where the session names no folder, a
    local session gets one of its own; a cluster must name one that all its machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """df written once to the shared folder and read from there, so that loops do not grow their plans and lost executors cost little."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step applied until the table's rows no longer change; compared by count and a sum of hashes."""
    mark, state = None, settle(state)
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64(*state.columns).cast("decimal(38,0)"))).first()
        if now == mark:
            return state
        mark, state = now, settle(step(state))


def cells(df: DataFrame, size: float | int, axes: tuple[str, ...] = ("z", "y", "x")) -> list[Column]:
    """The cell of a grid of cubes that a row is in, an expression for each axis."""
    return [F.floor(F.col(a) / F.lit(float(size))).cast("long").alias(f"c{a}") for a in axes]


def squared_distance(a: str, b: str, axes=("z", "y", "x"), scale: Scale = Scale()) -> Column:
    """Squared distance in double precision, added in the order of the axes."""
    out = None
    for axis in axes:
        k = scale.z if axis == "z" else scale.xy
        d = (F.col(f"{a}.{axis}") - F.col(f"{b}.{axis}")).cast("double")
        d = d if k == 1 else d * F.lit(float(k))
        out = d * d if out is None else out + d * d
    return out


def grid_join(left: DataFrame, right: DataFrame, radius: float, scale: Scale = Scale(), axes: tuple[str, ...] = ("z", "y", "x"), by: str | None = None) -> DataFrame:
    """All (left, right) rows at a distance of at most radius, as structs `l` and `r` with `d2`, the squared distance; with `by` only those that
    agree in that column, which comes along.

    Rows are keyed by their cell in a grid of cubes of side `radius`; the right side is copied to the 27 (in the plane 9) cells around its
    own, and equal cells meet in an ordinary equi-join, which Spark shuffles, and splits where cells are crowded. Work is in
    proportion to the rows plus the pairs in neighbouring cells; radius must be positive."""
    if radius <= 0:
        raise ValueError("a radius join needs a positive radius")
    side = {a: radius / (scale.z if a == "z" else scale.xy) for a in axes}
    at = lambda df: [F.floor(F.col(a) / F.lit(side[a])).cast("long").alias(f"c{a}") for a in axes]
    near = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(axes, shift)]) for shift in product((-1, 0, 1), repeat=len(axes))])
    also = [by] if by else []
    l = left.select(F.struct(*left.columns).alias("l"), *at(left), *also)
    r = right.select(F.struct(*right.columns).alias("r"), *at(right), *also, F.explode(near).alias("s"))
    r = r.select("r", *[(F.col(f"c{a}") + F.col(f"s.d{a}")).alias(f"c{a}") for a in axes], *also)
    pairs = l.join(r, [f"c{a}" for a in axes] + also).select("l", "r", squared_distance("l", "r", axes, scale).alias("d2"), *also)
    return pairs.where(F.col("d2") <= F.lit(float(radius) * float(radius)))


def knn_join(queries: DataFrame, points: DataFrame, k: int, radius: float | None = None, scale: Scale = Scale(), start: float | None = None, axes=("z", "y", "x"), self_join: bool = True, by: str | None = None) -> DataFrame:
    """For each query its k nearest points by (distance, id), as (q, n, d2, rank); fewer where there are no more. With self_join a row is not
    its own neighbour. Both sides have id and the axes. With `by`, a column of both, a query seeks among the points that agree in it, and the
    column comes along.

    With a radius, neighbours are sought in it alone. Without one, a first radius is guessed from the density of the points and doubled
    for the queries that found fewer than k within it, until none is left or the radius spans everything: what is found within a radius
    is final, since any nearer point would have been in it too. No side is ever paired with the whole of the other, except for
    queries whose neighbours are that far."""
    also = [by] if by else []
    order = Window.partitionBy("q", *also).orderBy("d2", "n")

    def within(q: DataFrame, r: float) -> DataFrame:
        pairs = grid_join(q, points, r, scale, axes, by).select(F.col("l.id").alias("q"), F.col("r.id").alias("n"), "d2", *also)
        pairs = pairs.where("q <> n") if self_join else pairs
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    if radius is not None:
        return within(queries, radius)
    bounds = points.agg(F.count("*").alias("n"), *[F.min(a).alias(f"lo_{a}") for a in axes], *[F.max(a).alias(f"hi_{a}") for a in axes]).first()
    others = queries.agg(*[F.min(a).alias(f"lo_{a}") for a in axes], *[F.max(a).alias(f"hi_{a}") for a in axes]).first()
    if not bounds.n or others[0] is None:
        return within(queries, 1.0)
    spans = [(max(bounds[f"hi_{a}"], others[f"hi_{a}"]) - min(bounds[f"lo_{a}"], others[f"lo_{a}"])) * (scale.z if a == "z" else scale.xy) for a in axes]
    whole = sum(s * s for s in spans) ** 0.5 + 1
    volume = 1.0
    for s in spans:
        volume *= max(s, scale.least)
    r = start or max(scale.least, (volume * (k + 1) / bounds.n) ** (1 / len(axes)))
    todo, found = queries, None
    while True:
        r = min(r, whole)
        near = settle(within(todo, r), "knn")
        full = near.groupBy("q", *also).agg(F.count("*").alias("m")).where(F.col("m") >= k).select("q", *also)
        last = r >= whole
        done = near if last else near.join(full, ["q", *also], "left_semi")
        found = done if found is None else found.unionByName(done)
        if last:
            return found
        todo = settle(todo.join(full.withColumnRenamed("q", "id"), ["id", *also], "left_anti"), "todo")
        if todo.isEmpty():
            return found
        r *= 2


#: Links that a task contracts at a time, and links up to which one task finishes the components of a graph.
AT_ONCE, LAST = 1 << 20, 1 << 18


def least_linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, the least end that it is linked to over any number of links (a, b)) of all ends that are not the least themselves."""
    ends, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    low = np.arange(len(ends))
    while len(i):
        # only the least ends known so far are hung under others, so that no end loses the one that it hangs under
        for a_end, b_end in ((low[i], low[j]), (low[j], low[i])):
            np.minimum.at(low, a_end, b_end)
        while (low != low[low]).any():
            low = low[low]
        apart = low[i] != low[j]
        i, j = i[apart], j[apart]
    moved = low != np.arange(len(ends))
    return ends[moved], ends[low[moved]]


def _stars(links: DataFrame) -> DataFrame:
    """(n, p) with the components of links (n, p): up to a million links of a task at a time become stars, before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rows in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in rows.columns])
            n += len(rows)
            if n >= AT_ONCE:
                yield pa.RecordBatch.from_arrays([*map(pa.array, least_linked(*(np.concatenate(x) for x in zip(*held))))], ["n", "p"])
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, least_linked(*(np.concatenate(x) for x in zip(*held))))], ["n", "p"])

    return links.mapInArrow(run, "n long, p long")


def components(links: DataFrame, a: str = "node_a", b: str = "node_b") -> DataFrame:
    """(id, component) for every end of a link; component is the smallest id. Alternating stars, from what each task has contracted: in each
    round larger neighbours hang under a node's smallest one, then parents under the smallest of them, until all is stars, or until few
    enough links (LAST) are left for one task to finish; rounds grow with the logarithm of size. What is joined are tables, so that
    Spark splits a node that has very many links."""
    first = settle(links.select(F.least(a, b).cast("long").alias("p"), F.greatest(a, b).cast("long").alias("n")), "ends")
    alone = first.where("p = n").select(F.col("n").alias("id")).distinct()
    tree, mark = settle(_stars(first.where("p < n").select("n", "p")).distinct(), "stars"), None
    while True:
        now = tree.agg(F.count("*"), F.sum(F.xxhash64("n", "p").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        if now[0] <= LAST:
            tree = settle(_stars(tree.coalesce(1)), "stars")
            break
        mark, both = now, tree.unionByName(tree.select(F.col("p").alias("n"), F.col("n").alias("p")))
        low = settle(both.groupBy("n").agg(F.min("p").alias("m")).select("n", F.least("n", "m").alias("m")), "low")
        large = settle(both.join(low, "n").where("p > n").select(F.col("p").alias("n"), F.col("m").alias("p")).distinct(), "large")
        small = large.join(settle(large.groupBy("n").agg(F.min("p").alias("m")), "low"), "n")
        tree = settle(small.select("n", F.col("m").alias("p")).unionByName(small.where("p > m").select(F.col("p").alias("n"), F.col("m").alias("p"))).distinct(), "stars")
    out = tree.select(F.col("n").alias("id"), F.col("p").alias("component")).unionByName(tree.select(F.col("p").alias("id"), F.col("p").alias("component")).distinct())
    return out.unionByName(alone.join(out.select("id"), "id", "left_anti").select("id", F.col("id").alias("component")))
