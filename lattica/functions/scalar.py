"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arcsinh(c: Column, cofactor: float = 150.0) -> Column:
    """Compressed intensity: 150 for fluorescence, 5 for mass cytometry."""
    return F.asinh(c / F.lit(float(cofactor)))


def kernel_size(length: Column, scale: float) -> Column:
    """A length as an odd number of voxels: twice the rounded radius, and one more."""
    return (2 * F.rint(length / F.lit(float(scale))) + 1).cast("long")


def blue_white_red(value: Column, low: Column, high: Column, centre: Column) -> Column:
    """RGB bytes of a value: blue at the low end, white at the centre, red at the high end."""
    t = F.when(value >= centre, F.coalesce(F.try_divide(value - centre, high - centre), F.lit(0.0))).otherwise(-F.coalesce(F.try_divide(centre - value, centre - low), F.lit(0.0)))
    t = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t))
    fade = F.rint(255 * (1 - F.abs(t))).cast("int")
    return F.when(t >= 0, F.array(F.lit(255), fade, fade)).otherwise(F.array(fade, fade, F.lit(255)))


def distinct_colours(keys: DataFrame, key: str) -> DataFrame:
    """(key, r, g, b): colours evenly around the wheel, in the order of the keys, full in saturation and brightness."""
    from ..operators.ranks import numbered

    rows = numbered(keys.select(key).distinct(), key, name="i")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    h = 6.0 * F.col("i") / F.col("n")
    channel = lambda shift: F.rint(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(F.pmod(h + shift, F.lit(6.0)) - 3) - 1))).cast("int")
    return rows.select(key, channel(0.0).alias("r"), channel(4.0).alias("g"), channel(2.0).alias("b"))


#: A few colours of the web's list by name and RGB.
COLOURS = [("black", 0, 0, 0), ("white", 255, 255, 255), ("gray", 128, 128, 128), ("red", 255, 0, 0), ("lime", 0, 255, 0), ("blue", 0, 0, 255), ("yellow", 255, 255, 0), ("cyan", 0, 255, 255), ("magenta", 255, 0, 255), ("orange", 255, 165, 0), ("purple", 128, 0, 128), ("brown", 165, 42, 42), ("pink", 255, 192, 203), ("green", 0, 128, 0), ("navy", 0, 0, 128), ("teal", 0, 128, 128), ("olive", 128, 128, 0), ("gold", 255, 215, 0)]


def nearest_colour(r: Column, g: Column, b: Column) -> Column:
    """The name of the listed colour at the least distance in RGB, ties by name."""
    options = [F.struct(((r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z)).cast("long").alias("d"), F.lit(name).alias("name")) for name, x, y, z in COLOURS]
    return F.array_min(F.array(*options))["name"]


def matches(column: Column, every: list[str], none: list[str]) -> Column:
    """True if the string holds all of the first and none of the second substrings."""
    return F.forall(F.array(*map(F.lit, every)).cast("array<string>"), lambda s: F.contains(column, s)) & ~F.exists(F.array(*map(F.lit, none)).cast("array<string>"), lambda s: F.contains(column, s))


def base_name(path: Column) -> Column:
    """File name without folders and without .tif or .tiff."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?i)\.tiff?$", "")


def natural_key(c: Column) -> Column:
    """A key that sorts names by the first number in them, then by name; names without one come last."""
    digits = F.regexp_extract(c, r"(\d+)", 1)
    return F.struct(F.when(digits == "", F.lit(None)).otherwise(digits.cast("decimal(38,0)")).isNull().alias("none"), F.when(digits == "", F.lit(None)).otherwise(digits).cast("decimal(38,0)").alias("n"), c.alias("name"))
