"""Connected components of a table of links by alternating stars: no step gathers a component or a neighbourhood anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forest, tidy, written

#: Links that a task contracts at a time, and links up to which one task finishes what is left.
CONTRACTED, LAST = 1 << 20, 1 << 18


def contracted(links: DataFrame) -> DataFrame:
    """(n, p) with the components of links (n, p): each stretch of CONTRACTED links of a task is a forest of stars, so that chains and crowds
    that a task holds already are gone before the first shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            a, b = forest(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["n", "p"])

        for rows in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in rows.columns])
            n += len(rows)
            if n >= CONTRACTED:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return links.mapInArrow(tidy(run), "n long, p long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every end of a link, root being the smallest node of its component. Null ends and links of a node to itself
    say nothing. Each round hangs larger neighbours of a node under its smallest one, then a node's parents under the smallest of them;
    after a logarithmic number of rounds all is stars, or few enough links (LAST) are left for one task to finish. Minima are combined
    before the shuffle and written, so that both sides of each join come from tables and Spark splits a node that has very many links."""
    ends = contracted(links.select(F.greatest(a, b).cast("long").alias("n"), F.least(a, b).cast("long").alias("p")).where("p < n"))
    tree, last = written(ends.distinct(), "links"), None
    while True:
        now = tree.agg(F.count("*"), F.sum(F.xxhash64("n", "p").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        if now[0] <= LAST:
            tree = written(contracted(tree.coalesce(1)), "stars")
            break
        last = now
        both = tree.unionByName(tree.select(F.col("p").alias("n"), F.col("n").alias("p")))
        low = written(both.groupBy("n").agg(F.min("p").alias("m")).select("n", F.least("n", "m").alias("m")), "low")
        large = written(both.join(low, "n").where("p > n").select(F.col("p").alias("n"), F.col("m").alias("p")).distinct(), "large")
        low = written(large.groupBy("n").agg(F.min("p").alias("m")), "low")
        small = large.join(low, "n")
        tree = small.select("n", F.col("m").alias("p")).unionByName(small.where("p > m").select(F.col("p").alias("n"), F.col("m").alias("p"))).distinct()
        tree = written(tree, "stars")
    return tree.select(F.col("n").alias("node"), F.col("p").alias("root")).unionByName(tree.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct())
