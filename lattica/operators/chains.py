"""Chains of a skeleton: how far each voxel is along the chain that it is part of, kernels at every k-th voxel, and bodies drawn along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..helpers import settle
from .voxels import AT, AROUND, inside, shifted


def place_key(at: list[Column]) -> Column:
    """A number for each place with coordinates from -2**20 to 2**20 - 1."""
    z, y, x = ((c.cast("long") + (1 << 20)) for c in at)
    return z * (1 << 42) + y * (1 << 21) + x


def places(key: str) -> list[Column]:
    """The coordinates of a place's number."""
    low = (1 << 21) - 1
    parts = [F.shiftright(key, 42), F.shiftright(key, 21).bitwiseAND(low), F.col(key).bitwiseAND(low)]
    return [(p - (1 << 20)).cast("int").alias(a) for p, a in zip(parts, AT)]


def neighbour_links(skeleton: DataFrame) -> DataFrame:
    """(u, v), the numbers of neighbouring voxels of a label, both ways."""
    own = skeleton.select(*AT, "label")
    moved = shifted(own.select(*AT, F.col("label").alias("m"), place_key([F.col(a) for a in AT]).alias("u")), AROUND)
    return own.join(moved, AT).where("label = m").select("u", place_key([F.col(a) for a in AT]).alias("v"))


def ranked(skeleton: DataFrame) -> DataFrame:
    """(v, end_a, first_a, end_b, first_b, rank, length) for every voxel between two of a chain: the voxels at both ends of its chain (with one
    neighbour, or more than two) and the chain's voxels beside them, how many steps the voxel is from end_a, and how many end_b is. (end_a, first_a)
    is the smaller of the two ways in; together the four name the chain. Rings without an end are no chains.

    A walk would take as many rounds as the longest chain has voxels. Instead every voxel points to the next one in both directions, and in each
    round to where its target points, so that pointers double and a chain of n voxels takes log2(n) joins."""
    links = settle(neighbour_links(skeleton), "links")
    inner = settle(links.groupBy("u").agg(F.count("*").alias("n")).where("n = 2").select("u"), "inner")
    ahead = links.join(inner, "u").join(inner.select(F.col("u").alias("v"), F.lit(True).alias("on")), "v", "left")
    step = F.lit(1).cast("long").alias("steps")
    none = F.lit(None).cast("long")
    done = ahead.where("on IS NULL").select("u", "v", none.alias("w"), step, F.col("v").alias("end"), F.col("u").alias("first"))
    after = links.select(F.col("u").alias("v"), F.col("v").alias("w"))
    going = ahead.where("on").select("u", "v").join(after, "v").where("u <> w").select("u", "v", "w", step, none.alias("end"), none.alias("first"))
    # (u, v) points to (v, w); later to an arc that is named by its two ends
    state = settle(done.unionByName(going).select("u", "v", F.when(F.col("w").isNotNull(), F.struct(F.col("v").alias("u"), F.col("w").alias("v"))).alias("to"), "steps", "end", "first"), "arcs")
    most, reach = inner.count(), 1
    while reach <= most and not state.where("to IS NOT NULL").isEmpty():
        target = state.select(F.struct("u", "v").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("end").alias("e"), F.col("first").alias("f"))
        moved = state.where("to IS NOT NULL").join(target, "to").select("u", "v", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("e").alias("end"), F.col("f").alias("first"))
        state, reach = settle(state.where("to IS NULL").unionByName(moved), "arcs"), 2 * reach
    ways = state.where("to IS NULL").groupBy(F.col("u").alias("v")).agg(F.min(F.struct("end", "first", "steps")).alias("a"), F.max(F.struct("end", "first", "steps")).alias("b"), F.count("*").alias("n"))
    return ways.where("n = 2").select("v", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("end", "first")], F.col("a.steps").alias("rank"), (F.col("a.steps") + F.col("b.steps")).alias("length"))


_CHAIN = ["end_a", "first_a", "end_b", "first_b"]


def kernel_links(skeleton: DataFrame, spacing: int = 1) -> DataFrame:
    """(u, v) pairs of kernels that follow one another: along every chain its ends and each voxel whose distance from end_a is a multiple of
    `spacing`, and ends that are neighbours. A kernel's successor has the next number in its chain, so the two meet by an ordinary join."""
    rows = settle(ranked(skeleton), "ranked")
    links = neighbour_links(skeleton)
    n = links.groupBy("u").agg(F.count("*").alias("n"))
    ends = n.where("n <> 2").select("u")
    touching = links.where("u < v").join(ends, "u", "left_semi").join(ends.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v")
    chains = rows.select(*_CHAIN, "length").distinct()
    last = F.ceil(F.col("length") / spacing).cast("long")
    marks = rows.where(F.col("rank") % spacing == 0).select(*_CHAIN, (F.col("rank") / spacing).cast("long").alias("i"), F.col("v").alias("k"))
    marks = marks.unionByName(chains.select(*_CHAIN, F.lit(0).cast("long").alias("i"), F.col("end_a").alias("k"))).unionByName(chains.select(*_CHAIN, last.alias("i"), F.col("end_b").alias("k")))
    marks = settle(marks, "marks")
    pairs = marks.join(marks.select(*_CHAIN, (F.col("i") - 1).alias("i"), F.col("k").alias("next")), [*_CHAIN, "i"])
    return pairs.select(F.least("k", "next").alias("u"), F.greatest("k", "next").alias("v")).unionByName(touching).distinct()


def tapered(segments: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(z, y, x, label) of the image's places in cylinders whose radius goes from ra at place a to rb at place b; of several segments that claim a
    place the smallest label has it.

    A cylinder is a row of balls, two for each voxel of its length (three if the radii differ by more than two, three at least); their middles
    are cut to whole places and their radii rounded to halves. Equal balls are drawn once, and a ball is made of intervals along x."""
    a, b = ({c: F.col(f"{s}.{c}").cast("double") for c in AT} for s in "ab")
    length = F.sqrt(sum((a[c] - b[c]) * (a[c] - b[c]) for c in AT))
    many = F.greatest(F.lit(3), F.floor(length * F.when(F.abs(F.col("ra") - F.col("rb")) > 2, 3.0).otherwise(2.0))).cast("int")
    many = F.when(length < 0.5, 1).otherwise(many)
    ra, rb = F.col("ra").cast("double"), F.col("rb").cast("double")
    rows = segments.select("label", "a", "b", ra.alias("ra"), rb.alias("rb"), many.alias("many"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("i"))
    t = F.when(F.col("i") == F.col("many") - 1, 1.0).otherwise(F.col("i") * F.try_divide(F.lit(1.0), F.col("many") - 1))
    one = F.col("many") == 1
    middle = [F.when(one, a[c]).otherwise(a[c] * (1 - t) + b[c] * t).cast("int").alias(c) for c in AT]
    radius = F.when(one, F.greatest(ra, rb)).otherwise(ra * (1 - t) + rb * t)
    balls = rows.select("label", *middle, (F.rint(radius * 2) / 2).alias("r")).groupBy(*AT, "r").agg(F.min("label").alias("label"))
    reach = F.floor("r").cast("int")
    span = lambda n: F.sequence(-n, n)
    rows = balls.select(*AT, "r", "label", F.explode(span(reach)).alias("dz"))
    rows = rows.select(*AT, "r", "label", "dz", F.explode(span(F.floor(F.sqrt(F.col("r") * F.col("r") - F.col("dz") * F.col("dz"))).cast("int"))).alias("dy"))
    wide = F.floor(F.sqrt(F.col("r") * F.col("r") - F.col("dz") * F.col("dz") - F.col("dy") * F.col("dy"))).cast("int")
    rows = rows.select((F.col("z") + F.col("dz")).alias("z"), (F.col("y") + F.col("dy")).alias("y"), "label", F.explode(F.sequence(F.col("x") - wide, F.col("x") + wide)).alias("x"))
    return inside(rows, shape).groupBy(*AT).agg(F.min("label").alias("label"))


def _over(image: DataFrame, drawn: DataFrame) -> DataFrame:
    """The image, with what was drawn where it is free."""
    return image.select(*AT, "label").unionByName(drawn.join(image.select(*AT), AT, "left_anti").select(*AT, "label"))


def joined_ends(image: DataFrame, ends: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """The image with a tapered cylinder for each pair of ends (label_a, label_b, a, b, ra, rb), labelled by the smaller label."""
    return _over(image, tapered(ends.select(F.least("label_a", "label_b").alias("label"), "a", "b", "ra", "rb"), shape))


def bodies(skeleton: DataFrame, depth: DataFrame, shape: tuple[int, int, int], spacing: int = 1) -> DataFrame:
    """(z, y, x, label): the skeleton as tapered cylinders between the kernels along its chains, as thick as the object was there (depth, at
    (z, y, x); 1 if unknown)."""
    at = skeleton.select(place_key([F.col(a) for a in AT]).alias("k"), *AT, "label").join(depth.select(*AT, "depth"), AT, "left")
    at = settle(at.select("k", "label", F.struct(*AT).alias("at"), F.coalesce("depth", F.lit(1.0)).alias("r")), "kernels")
    side = lambda u, p, r: at.select(F.col("k").alias(u), F.col("at").alias(p), F.col("r").alias(r), *(["label"] if u == "u" else []))
    return tapered(kernel_links(skeleton, spacing).join(side("u", "a", "ra"), "u").join(side("v", "b", "rb"), "v"), shape)
