"""Edges as they arrive: running weights and degrees, and co-occurrence within windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_graph(edges: DataFrame) -> DataFrame:
    """The weighted graph of a stream of edges, for the update or complete mode; state grows with the pairs."""
    return edges.groupBy(F.least("node_a", "node_b").alias("src"), F.greatest("node_a", "node_b").alias("dst")).agg(F.count("*").alias("weight"))


def running_degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("node_a", "node_b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def windowed_counts(events: DataFrame, time: str, node: str, width: str, late: str) -> DataFrame:
    """(start, node, n) in windows of time; a window is final once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(node).alias("node")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "node", "n")
