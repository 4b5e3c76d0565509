"""Numbers for rows without a sort of everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, *order, start: int = 0, name: str = "number") -> DataFrame:
    """df with consecutive numbers in the given order: rows are dealt out by ranges and sorted there, and a partition's first number is the
    count of the rows before it. Only a row for each partition meets in one task."""
    from ..helpers import settle

    parts = settle(df.repartitionByRange(*[F.col(o) if isinstance(o, str) else o for o in order]).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.row_number().over(inside) - 1 + start).drop("_part", "_before")


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median) of each group, exact. Equal values are counted first; counts are dealt out by ranges of (keys, value), and running sums over
    the ranges say which values stand in the middle of their group. No group is one task's work, however many rows or values it has."""
    from ..helpers import settle

    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    parts = settle(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.sum("_n").alias("_all"))
    before = sizes.select("_part", (F.sum("_all").over(Window.orderBy("_part")) - F.col("_all")).alias("_before"))  # a row for each partition
    running = Window.partitionBy("_part").orderBy(*keys, value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = settle(parts.join(F.broadcast(before), "_part").select(*keys, value, "_n", (F.col("_before") + F.sum("_n").over(running)).alias("_to")), "ranked")
    groups = ranked.groupBy(*keys).agg(F.min(F.col("_to") - F.col("_n")).alias("_from"), F.sum("_n").alias("_all"))
    at = lambda half: (F.col("_to") - F.col("_n") <= half) & (half < F.col("_to"))
    low, high = (F.col("_from") + F.floor(n / 2) for n in (F.col("_all") - 1, F.col("_all")))
    middle = ranked.join(groups, keys).where(at(low) | at(high)).groupBy(*keys)
    return middle.agg(((F.max(F.when(at(low), F.col(value))) + F.max(F.when(at(high), F.col(value)))) / 2).alias("median"))
