"""Brightness evened out along the axes, shell by shell of the distance to the background."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..helpers import settle
from ..model import Scale
from .distance import AT, squared_depths
from .ranks import medians


def evened(image: DataFrame, scale: Scale = Scale(), shells: int = 20, most: float = 10.0, boost_only: bool = False, axes: tuple[str, ...] = ("z", "y", "x"), column: str = "value") -> DataFrame:
    """(z, y, x, value): the image after a correction along each of the axes in turn, each on what the one before it left.

    Along an axis, every slice has its own distances to the background (what is not positive, or beyond the image), and their whole range is cut into
    `shells` equal shells. The median of a shell's values at each position of the axis, over all slices, is its profile; values are scaled by the
    median of the profile over the profile itself, within 1 / most and most (with boost_only not below 1). A shell at a single position, or with a
    median below 1e-6, stays as it is, and background is 0.

    Distances go line by line, medians by ranks over ranges; no slice, shell or position is one task's work."""
    rows = settle(image.where(F.col(column) > 0).select(*AT, F.lit(1).alias("label"), F.col(column).cast("double").alias("value")), "tissue")
    for axis in axes:
        deep = settle(squared_depths(rows, scale, tuple(a for a in AT if a != axis), also="value").withColumn("depth", F.sqrt("d2")), "depths")
        deepest = deep.agg(F.max("depth")).first()[0]
        if deepest is None or deepest < 1e-6:
            continue
        edges = np.linspace(0, deepest, shells + 1)[:-1]
        shelled = deep.select(*AT, "label", "value", F.size(F.filter(F.array(*map(F.lit, edges.tolist())), lambda e: e <= F.col("depth"))).alias("shell"))
        profile = settle(medians(shelled, ["shell", axis], "value"), "profile")
        middle = profile.groupBy("shell").agg(F.median("median").alias("middle"), F.count("*").alias("positions")).where("positions > 1 AND middle >= 1e-6")
        ratio = F.when(F.col("median") > 1e-6, F.col("middle") / F.col("median")).otherwise(1.0)
        ratio = F.least(F.greatest(ratio, F.lit(1.0 if boost_only else 1.0 / most)), F.lit(most))
        ratios = profile.join(middle, "shell").select("shell", axis, ratio.alias("ratio"))
        rows = settle(shelled.join(ratios, ["shell", axis], "left").select(*AT, "label", (F.col("value") * F.coalesce("ratio", F.lit(1.0))).alias("value")), "evened")
    return image.select(*AT).join(rows.select(*AT, "value"), AT, "left").select(*AT, F.coalesce("value", F.lit(0.0)).alias("value"))
