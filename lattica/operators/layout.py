"""Places of nodes for drawing."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..helpers import settle
from .edges import neighbours
from .graph import vertices
from .ranks import numbered


def ring(nodes: DataFrame) -> DataFrame:
    """(id, px, py) evenly on the unit circle, in the order of ids."""
    rows = numbered(nodes.select("id").distinct(), "id", name="i")
    turn = 2 * math.pi * F.col("i") / F.col("n")
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).select("id", F.cos(turn).alias("px"), F.sin(turn).alias("py"))


def shells(communities: DataFrame) -> DataFrame:
    """(id, px, py): a circle for each community, larger ones farther out."""
    size = communities.groupBy("com").agg(F.count("*").alias("n"))
    order = numbered(size, "n", "com", start=1, name="radius")
    rows = communities.join(order, "com").withColumn("i", F.row_number().over(Window.partitionBy("com").orderBy("id")) - 1)
    turn = 2 * math.pi * F.col("i") / F.col("n")
    return rows.select("id", (F.col("radius") * F.cos(turn)).alias("px"), (F.col("radius") * F.sin(turn)).alias("py"))


def spring(graph: DataFrame, rounds: int = 10, cell: float = 0.25) -> DataFrame:
    """(id, px, py): from the ring, links pull and nodes of the same cell of a grid push, in shrinking steps. Pushes come from a cell's
    middle, so that a crowded cell costs its size and not its square."""
    links = settle(neighbours(graph).where("src <> dst").select("src", "dst"), "links")

    def pull(at: DataFrame) -> DataFrame:
        a, b = at.select(F.col("id").alias("src"), F.col("px").alias("ax"), F.col("py").alias("ay")), at.select(F.col("id").alias("dst"), F.col("px").alias("bx"), F.col("py").alias("by"))
        return links.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("id")).agg(F.avg(F.col("bx") - F.col("ax")).alias("fx"), F.avg(F.col("by") - F.col("ay")).alias("fy"))

    return springs(ring(vertices(graph)), pull, rounds, cell)


def springs(at: DataFrame, pull: Callable[[DataFrame], DataFrame], rounds: int, cell: float) -> DataFrame:
    """The rounds of `spring` from places at; pull(at) gives (id, fx, fy), how far links pull."""
    at = settle(at, "layout")
    for turn in range(rounds):
        step = 0.1 * (1 - turn / rounds)
        cells = at.select("*", F.floor(F.col("px") / cell).alias("cx"), F.floor(F.col("py") / cell).alias("cy"))
        mid = cells.groupBy("cx", "cy").agg(F.avg("px").alias("mx"), F.avg("py").alias("my"), F.count("*").alias("n"))
        push = cells.join(mid, ["cx", "cy"]).select("id", ((F.col("px") - F.col("mx")) * F.log1p("n")).alias("gx"), ((F.col("py") - F.col("my")) * F.log1p("n")).alias("gy"))
        now = at.join(pull(at), "id", "left").join(push, "id")
        at = settle(now.select("id", (F.col("px") + step * (F.coalesce("fx", F.lit(0.0)) + F.col("gx"))).alias("px"), (F.col("py") + step * (F.coalesce("fy", F.lit(0.0)) + F.col("gy"))).alias("py")), "layout")
    return at
