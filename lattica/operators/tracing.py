"""Pixel classification, threshold prediction, and the repair of filaments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..helpers import components, grid_join, settle
from ..model import Scale
from .voxels import AROUND, AT, neighbour_counts, shifted

SIGMAS = (1.0, 2.0, 4.0)


def _smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    n = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in range(a.ndim):
        if a.shape[axis] > 1:
            a = np.apply_along_axis(lambda v: np.convolve(np.pad(v, n, mode="edge"), k, "valid"), axis, a)
    return a


def features(block: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Names and maps of a block's features: smoothed values, differences of scales, gradient, Laplacian, Hessian and structure-tensor
    eigenvalues, and the local least, greatest, mean and variance."""
    names, maps = ["value"], [block]
    smooth = {s: _smooth(block, s) for s in SIGMAS}
    axes = [i for i in range(block.ndim) if block.shape[i] > 1]
    for s, g in smooth.items():
        grads = [np.gradient(g, axis=i) for i in axes]
        hess = np.stack([np.stack([np.gradient(d, axis=j) for j in axes], -1) for d in grads], -2)
        tensor = np.stack([np.stack([_smooth(a * b, s) for b in grads], -1) for a in grads], -2)
        names += [f"smooth{s:g}", f"gradient{s:g}", f"laplace{s:g}"] + [f"{k}{s:g}_{i}" for k in ("hessian", "structure") for i in range(len(axes))]
        maps += [g, np.sqrt(sum(d * d for d in grads)), np.trace(hess, axis1=-2, axis2=-1)] + [m for t in (hess, tensor) for m in np.moveaxis(np.linalg.eigvalsh((t + np.swapaxes(t, -1, -2)) / 2), -1, 0)]
    names += [f"between{a:g}_{b:g}" for a, b in zip(SIGMAS, SIGMAS[1:])]
    maps += [smooth[a] - smooth[b] for a, b in zip(SIGMAS, SIGMAS[1:])]
    pad = np.pad(block, [(1, 1) if s > 1 else (0, 0) for s in block.shape], mode="edge")
    near = np.lib.stride_tricks.sliding_window_view(pad, [3 if s > 1 else 1 for s in block.shape]).reshape(*block.shape, -1)
    names += ["least", "greatest", "mean", "variance"]
    maps += [near.min(-1), near.max(-1), near.mean(-1), near.var(-1)]
    return names, np.stack(maps, -1)


def pixel_features(image: DataFrame, shape: tuple[int, int, int], chunk: int = 32, halo: int = 17, column: str = "value") -> DataFrame:
    """(z, y, x, features) for every place of the image. Rows are copied to the chunks whose halo they are in, and a chunk is one task's work."""
    size = [min(chunk, n) for n in shape]
    keys = [F.array_distinct(F.array(*[F.greatest(F.lit(0), F.least(F.lit((n - 1) // s), F.floor((F.col(a) + d) / s))).cast("int") for d in (-halo, 0, halo)])) if n > s else F.array(F.lit(0)) for a, n, s in zip(AT, shape, size)]
    rows = image.select(*AT, F.col(column).cast("double").alias("v"))
    for k, name in zip(keys, ("kz", "ky", "kx")):
        rows = rows.withColumn(name, F.explode(k))
    spark = image.sparkSession
    every = [spark.range((n - 1) // s + 1).select(F.col("id").cast("int").alias(k)) for n, s, k in zip(shape, size, ("kz", "ky", "kx"))]
    chunks = every[0].crossJoin(F.broadcast(every[1])).crossJoin(F.broadcast(every[2]))
    rows = chunks.join(rows, ["kz", "ky", "kx"], "left")

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lo = [max(0, k * s - halo) for k, s in zip(key, size)]
        hi = [min(n, (k + 1) * s + halo) for k, s, n in zip(key, size, shape)]
        block = np.zeros([b - a for a, b in zip(lo, hi)])
        pdf = pdf.dropna()
        at = pdf[AT].to_numpy().astype(int)
        ok = ((at >= lo) & (at < hi)).all(1)
        block[tuple((at[ok] - lo).T)] = pdf["v"].to_numpy()[ok]
        _, maps = features(block)
        own = [slice(k * s - a, min((k + 1) * s, n) - a) for k, s, a, n in zip(key, size, lo, shape)]
        part = maps[tuple(own)]
        z, y, x = np.indices(part.shape[:3]).reshape(3, -1)
        return pd.DataFrame({"z": z + own[0].start + lo[0], "y": y + own[1].start + lo[1], "x": x + own[2].start + lo[2], "features": list(part.reshape(-1, part.shape[-1]))})

    return rows.groupBy("kz", "ky", "kx").applyInPandas(one, "z int, y int, x int, features array<double>")


def classify_pixels(feature_rows: DataFrame, marks: DataFrame, trees: int = 20) -> DataFrame:
    """(z, y, x, foreground) by boosted trees trained on marked places (z, y, x, mark 0 or 1)."""
    from pyspark.ml.functions import array_to_vector

    rows = feature_rows.select(*AT, array_to_vector("features").alias("features"))
    train = rows.join(marks.select(*AT, F.col("mark").cast("double").alias("label")), AT)
    model = GBTClassifier(maxIter=trees, maxDepth=5, seed=42).fit(train)
    return model.transform(rows).select(*AT, F.col("prediction").cast("int").alias("foreground"))


def predict_thresholds(samples: DataFrame, feature_columns: list[str], targets: list[str], rows: DataFrame, most: int = 50_000, layers: tuple[int, ...] = (64, 32, 16), epochs: int = 400, seed: int = 42) -> DataFrame:
    """rows with a column `predicted_<target>` for each target, by one network of rectified layers for all of them; features and targets are scaled
    to mean 0 and deviation 1. It is fitted on the `most` samples with the smallest hashes, which are the user's own marked histograms; rows
    are predicted where they are. A null is the feature's mean."""
    chosen = samples.select(*[F.col(c).cast("double").alias(c) for c in [*feature_columns, *targets]]).dropna(subset=targets)
    pdf = chosen.orderBy(F.xxhash64(*chosen.columns), *chosen.columns).limit(most).toPandas()
    x, y = pdf[feature_columns].to_numpy(float), pdf[targets].to_numpy(float)
    if not len(x):
        raise ValueError("no samples to learn thresholds from")
    mid, mid_y = np.nan_to_num(np.nanmean(x, 0)), y.mean(0)
    x = np.where(np.isnan(x), mid, x)
    wide, wide_y = x.std(0), y.std(0)
    wide[wide == 0], wide_y[wide_y == 0] = 1, 1
    net = fit_network((x - mid) / wide, (y - mid_y) / wide_y, layers, epochs, seed)

    @F.pandas_udf("array<double>")
    def run(*columns: pd.Series) -> pd.Series:
        z = np.stack([c.to_numpy(float) for c in columns], 1)
        z = (np.where(np.isnan(z), mid, z) - mid) / wide
        return pd.Series(list(forward(net, z)[-1] * wide_y + mid_y))

    found = rows.withColumn("_found", run(*[F.col(c).cast("double") for c in feature_columns]))
    return found.select(*rows.columns, *[F.col("_found")[i].alias(f"predicted_{t}") for i, t in enumerate(targets)])


def forward(net: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """What each layer gives for rows x; the last one is not rectified."""
    out = [x]
    for i in range(0, len(net), 2):
        x = x @ net[i] + net[i + 1]
        x = np.maximum(x, 0) if i + 2 < len(net) else x
        out.append(x)
    return out


def fit_network(x: np.ndarray, y: np.ndarray, layers: tuple[int, ...], epochs: int, seed: int, batch: int = 256, rate: float = 3e-3) -> list[np.ndarray]:
    """Weights and offsets of each layer in turn, by Adam on the squared error with a slowly falling rate."""
    rng, sizes = np.random.default_rng(seed), [x.shape[1], *layers, y.shape[1]]
    net = [w for a, b in zip(sizes, sizes[1:]) for w in (rng.standard_normal((a, b)) * (2 / a) ** 0.5, np.zeros(b))]
    mean, square, step = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            some = order[at : at + batch]
            states = forward(net, x[some])
            error, step, now = 2 * (states[-1] - y[some]) / len(some), step + 1, rate * (1 - epoch / epochs) + 1e-5
            for i in range(len(net) - 2, -1, -2):
                grads = (states[i // 2].T @ error, error.sum(0))
                error = error @ net[i].T * (states[i // 2] > 0)
                for j, g in zip((i, i + 1), grads):
                    mean[j] += 0.1 * (g - mean[j])
                    square[j] += 0.001 * (g * g - square[j])
                    net[j] -= now * (mean[j] / (1 - 0.9**step)) / (np.sqrt(square[j] / (1 - 0.999**step)) + 1e-8)
    return net


def end_points(skeleton: DataFrame) -> DataFrame:
    """Voxels with exactly one neighbour of their label."""
    return neighbour_counts(skeleton).where("n = 1").select(*AT, "label")


def joinable_ends(skeleton: DataFrame, distance: float, scale: Scale = Scale()) -> DataFrame:
    """Pairs of ends of different labels within a distance: (label_a, label_b, a, b, dist)."""
    ends = settle(end_points(skeleton), "ends")
    pairs = grid_join(ends, ends, distance, scale).where("l.label < r.label")
    at = lambda s: F.struct(*[F.col(f"{s}.{c}").alias(c) for c in AT])
    return pairs.select(F.col("l.label").alias("label_a"), F.col("r.label").alias("label_b"), at("l").alias("a"), at("r").alias("b"), F.sqrt("d2").alias("dist"))


def walks(skeleton: DataFrame, steps: int) -> DataFrame:
    """(from, step, z, y, x) for every voxel: the voxels of its own label that are 1 to `steps` steps from it along the skeleton."""
    own = settle(skeleton.select(*AT, "label"), "skeleton")
    links = settle(own.join(shifted(own.select(*AT, F.struct(*AT).alias("from"), F.col("label").alias("m")), AROUND), AT).where("label = m").select("from", F.struct(*AT).alias("to")), "links")
    seen = settle(links.select("from", "to", F.lit(1).alias("step")), "walks")
    front = seen
    for step in range(2, steps + 1):
        ahead = front.select(F.col("from").alias("start"), F.col("to").alias("from")).join(links, "from").where("start <> to").select(F.col("start").alias("from"), "to").distinct()
        front = settle(ahead.join(seen, ["from", "to"], "left_anti").select("from", "to", F.lit(step).alias("step")), "walks")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.select("from", "step", "to.*")


def kernels(skeleton: DataFrame, depth: DataFrame | None = None, steps: int = 5, window: int = 5) -> DataFrame:
    """Skeleton voxels (z, y, x, label) with what scores look at: is_end (one neighbour at most), radius (the depth of the object there, from
    depth (z, y, x, depth); 1 if unknown), density (skeleton voxels in the box of 2 window + 1 places along each axis over its places) and
    (vz, vy, vx), the unit vector into the skeleton: towards the mean of the voxels up to `steps` steps along it, farther ones
    weighing up to twice as much; (1, 0, 0) for a lone voxel."""
    own = settle(skeleton.select(*AT, "label"), "skeleton")
    weight = 1 + (F.col("step") - 1) / F.lit(float(max(steps - 1, 1)))
    mean = walks(own, steps).groupBy("from").agg(*[(F.sum(weight * (F.col(a) - F.col(f"from.{a}"))) / F.sum(weight)).alias(f"m{a}") for a in AT])
    norm = F.sqrt(sum(F.col(f"m{a}") * F.col(f"m{a}") for a in AT))
    mean = mean.select("from.*", *[F.when(norm > 1e-10, F.col(f"m{a}") / norm).otherwise(F.lit(1.0 if a == "z" else 0.0)).alias(f"v{a}") for a in AT])
    # boxes are counted through coarse cells: a voxel looks at the cells around its own
    side = 2 * window + 1
    box = grid_join(own.select(*AT), own.select(*AT), window * 3**0.5).where(" AND ".join(f"abs(l.{a} - r.{a}) <= {window}" for a in AT))
    dense = box.groupBy(*[F.col(f"l.{a}").alias(a) for a in AT]).agg((F.count("*") / F.lit(float(side**3))).alias("density"))
    out = neighbour_counts(own).join(mean, AT, "left").join(dense, AT, "left")
    out = out.join(depth.select(*AT, F.col("depth").alias("radius")), AT, "left") if depth is not None else out.withColumn("radius", F.lit(1.0))
    vector = [F.coalesce(f"v{a}", F.lit(1.0 if a == "z" else 0.0)).alias(f"v{a}") for a in AT]
    return out.select(*AT, "label", (F.col("n") <= 1).alias("is_end"), F.coalesce("radius", F.lit(1.0)).alias("radius"), "density", *vector)


def _met(left: DataFrame, right: DataFrame, distance: float, skeleton: DataFrame) -> DataFrame:
    """Pairs (l, r) of kernels of different labels within the distance, with gap, radius_ratio, mean_radius, ahead_l and ahead_r (how far the
    vectors of both agree with the direction from l to r), same (how far they agree with one another) and support (the share of ten
    places on the line between the two that are skeleton)."""
    pairs = settle(grid_join(left, right, distance).where("l.label <> r.label AND d2 > 0"), "pairs")
    to = {a: (F.col(f"r.{a}") - F.col(f"l.{a}")) / F.sqrt("d2") for a in AT}
    line = pairs.select("l", "r", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    line = line.select("l", "r", *[F.rint(F.col(f"l.{a}") + (F.col(f"r.{a}") - F.col(f"l.{a}")) * F.col("i") / 9).cast("int").alias(a) for a in AT])
    on = line.join(skeleton.select(*AT).distinct(), AT, "left_semi").groupBy("l", "r").agg((F.count("*") / F.lit(10.0)).alias("support"))
    radius = [F.col("l.radius"), F.col("r.radius")]
    return pairs.join(on, ["l", "r"], "left").select(
        "l", "r", F.sqrt("d2").alias("gap"), (F.least(*radius) / (F.greatest(*radius) + 1e-10)).alias("radius_ratio"), ((radius[0] + radius[1]) / 2).alias("mean_radius"),
        sum(F.col(f"l.v{a}") * to[a] for a in AT).alias("ahead_l"), sum(F.col(f"r.v{a}") * to[a] for a in AT).alias("ahead_r"),
        sum(F.col(f"l.v{a}") * F.col(f"r.v{a}") for a in AT).alias("same"), F.coalesce("support", F.lit(0.0)).alias("support"),
    )


def stitches(skeleton: DataFrame, distance: float, depth: DataFrame | None = None, least: float = 2.0, most_similar: float = 0.7, most_back: float = 0.3) -> DataFrame:
    """(label_a, label_b, score): pairs of ends of two branches whose score is above `least`; each end is in one pair at most, its best.

    The vectors of both ends point into their branches. Ends that point the same way (more than most_similar), or of which one's branch
    lies on the side of the gap (more than most_back), are left out. Like radii, branches that lie away from the gap, and opposite
    vectors add to the score, and so does the radius of two well matched ends."""
    ends = settle(kernels(skeleton, depth).where("is_end").withColumn("key", F.xxhash64(*AT, "label")), "ends")
    rows = _met(ends, ends, distance, skeleton).where("l.label < r.label")
    rows = rows.where((F.col("same") <= most_similar) & (F.col("ahead_l") <= most_back) & (F.col("ahead_r") >= -most_back))
    away = F.col("ahead_r") - F.col("ahead_l")
    score = 15 * F.col("radius_ratio") + 10 * away + 5 * F.greatest(F.lit(0.0), -F.col("same")) + F.when((F.col("radius_ratio") > 0.7) & (away > 1), 1.5 * F.col("mean_radius")).otherwise(0.0)
    rows = rows.select(F.col("l.key").alias("ka"), F.col("r.key").alias("kb"), F.col("l.label").alias("label_a"), F.col("r.label").alias("label_b"), score.alias("score")).where(F.col("score") > least)
    both = rows.select("ka", "kb", "score").unionByName(rows.select(F.col("kb").alias("ka"), F.col("ka").alias("kb"), "score"))
    best = both.groupBy("ka").agg(F.min_by("kb", F.struct((-F.col("score")).alias("s"), "kb")).alias("kb"))
    mutual = rows.join(best, ["ka", "kb"], "left_semi").join(best.select(F.col("ka").alias("kb"), F.col("kb").alias("ka")), ["ka", "kb"], "left_semi")
    return mutual.select("label_a", "label_b", "score")


def gap_links(skeleton: DataFrame, distance: float, depth: DataFrame | None = None, tolerance: float = 5.0, least: float = 2.0) -> DataFrame:
    """(label_a, label_b, score): filaments that an end reaches across a gap of at most `distance`, or three times its radius. A link needs a path
    of skeleton along more than half the line, or a score above `least` and radii that are alike: by half if the end points at the
    other, by 0.7 otherwise. Voxels that are no ends must also lie in line with it."""
    k = settle(kernels(skeleton, depth, steps=10), "kernels")
    # ends of thick filaments reach farther: a join for each doubling of the reach, so that a few of them do not widen the search of all
    own = F.greatest(F.lit(float(distance)), 3 * F.col("radius"))
    ends = settle(k.where("is_end").withColumn("reach", own).withColumn("step", F.greatest(F.lit(0), F.ceil(F.log2(own / distance) - 1e-9)).cast("int")), "ends")
    rows = None
    for step in sorted(r.step for r in ends.select("step").distinct().collect()):  # a number for each doubling
        met = _met(ends.where(F.col("step") == step), k, distance * 2.0**step, skeleton).where(F.col("gap") <= F.col("l.reach")).withColumn("l", F.col("l").dropFields("reach", "step"))
        rows = met if rows is None else rows.unionByName(met)
    if rows is None:
        return skeleton.sparkSession.createDataFrame([], "label_a long, label_b long, score double")
    ratio = F.col("gap") / (F.col("mean_radius") + 1e-10)
    in_line = (F.abs("ahead_l") + F.abs("ahead_r")) / 2
    score = 3 * F.col("radius_ratio") + F.when(ratio < tolerance, 2 * (tolerance - ratio)).otherwise(tolerance - ratio) - 0.5 * F.abs(F.col("l.density") - F.col("r.density")) + 2 * in_line + 1.5 * F.least(F.abs("ahead_l"), F.abs("ahead_r")) + F.when(F.col("support") > 0.3, 5.0).otherwise(0.0)
    rows = rows.withColumn("score", score).withColumn("in_line", in_line)
    good = (F.col("support") > 0.5) | (F.col("score") > least) & ((F.col("ahead_l") > 0.3) & (F.col("radius_ratio") > 0.5) | (F.col("radius_ratio") > 0.7))
    rows = rows.where(good & (F.col("r.is_end") | (F.col("in_line") >= 0.5)))
    return rows.groupBy(F.least("l.label", "r.label").alias("label_a"), F.greatest("l.label", "r.label").alias("label_b")).agg(F.max("score").alias("score"))


def screened(filaments: DataFrame, depth: DataFrame | None = None, least: int = 20) -> DataFrame:
    """Filaments (z, y, x, label) without those that look like noise: of fewer than `least` voxels, small round ones, and lone voxels of thin objects."""
    rows = filaments.join(depth.select(*AT, F.col("depth").alias("radius")), AT, "left") if depth is not None else filaments.withColumn("radius", F.lit(1.0))
    mean = [F.avg(a).alias(f"m{a}") for a in AT]
    spread = [F.covar_pop(a, b).alias(f"c{a}{b}") for i, a in enumerate(AT) for b in AT[i:]]
    per = rows.groupBy("label").agg(F.count("*").alias("n"), F.max("radius").alias("radius"), *mean, *spread, F.sqrt(sum(F.pow(F.max(a) - F.min(a), F.lit(2.0)) for a in AT)).alias("diagonal"))
    off = rows.join(per.select("label", *[f"m{a}" for a in AT]), "label").groupBy("label").agg(F.avg(F.sqrt(sum((F.col(a) - F.col(f"m{a}")) * (F.col(a) - F.col(f"m{a}")) for a in AT))).alias("off"))

    @F.pandas_udf("double")
    def linearity(zz: pd.Series, zy: pd.Series, zx: pd.Series, yy: pd.Series, yx: pd.Series, xx: pd.Series) -> pd.Series:
        m = np.stack([zz, zy, zx, zy, yy, yx, zx, yx, xx], 1).astype(float).reshape(-1, 3, 3)
        w = np.linalg.eigvalsh(m)
        return pd.Series(w[:, 2] / (w[:, 0] + 1e-10))

    per = per.join(off, "label").withColumn("linearity", linearity(*[f"c{a}{b}" for i, a in enumerate(AT) for b in AT[i:]])).withColumn("elongation", F.col("diagonal") / (F.col("off") + 1))
    noise = (F.col("n") < least) | (F.col("elongation") < 1.5) & (F.col("linearity") < 2) & (F.col("n") < 30) & (F.col("radius") < 5) | (F.col("n") == 1) & (F.col("radius") < 2)
    return filaments.join(per.where(noise).select("label"), "label", "left_anti").select(*AT, "label")


def trace(skeleton: DataFrame, distance: float, least: int = 20, depth: DataFrame | None = None) -> DataFrame:
    """Voxels relabelled by filament: branches linked across gaps are one, numbered by their smallest label, and noise is left out. Links are all
    judged on the branches as they are, in no order."""
    joined = settle(gap_links(skeleton, distance, depth), "links")
    parts = components(joined, "label_a", "label_b").select(F.col("id").alias("label"), "component")
    rows = settle(skeleton.join(parts, "label", "left").select(*AT, F.coalesce("component", "label").alias("label")), "filaments")
    return screened(rows, depth, least)


def local_maxima(image: DataFrame, least: float, distance: int = 1, column: str = "value") -> DataFrame:
    """Places above `least` that no place within `distance` along each axis exceeds; of equal ones so near to one another the first by place."""
    key = F.struct((-F.col(column)).alias("v"), *AT)
    reach = range(-distance, distance + 1)
    best = image.select(*AT, key.alias("k"))
    for axis in AT:  # a box is the least along one axis after the other
        best = best.select(*[F.explode(F.array(*[F.col(a) + d for d in reach])).alias(a) if a == axis else F.col(a) for a in AT], "k").groupBy(*AT).agg(F.min("k").alias("k"))
    own = F.struct((-F.col("value")).alias("v"), *AT)
    return image.where(F.col(column) > least).select(*AT, F.col(column).alias("value")).join(best, AT).where(F.col("k") == own).select(*AT, "value")


def grey_watershed(image: DataFrame, least: float, distance: int = 1, column: str = "value", scale: Scale = Scale()) -> DataFrame:
    """(z, y, x, label): the places of the image above 0, flooded from its local maxima above `least`, the brightest place first. An image of two
    values is one of depths first. Seeds are numbered by place; what no seed reaches is left out."""
    from .ranks import numbered
    from .voxels import connected, depths, spilled

    bright = settle(image.where(F.col(column) > 0).select(*AT, F.col(column).cast("double").alias("value")), "image")
    parts = settle(connected(bright), "parts")
    if bright.select("value").distinct().limit(2).count() == 1:
        bright = settle(depths(parts, scale).select(*AT, F.col("depth").alias("value")), "image")
    seeds = settle(numbered(local_maxima(bright, least, distance), *AT, start=1, name="seed").select(*AT, "seed"), "seeds")
    rows = bright.join(parts, AT).join(seeds, AT, "left").select(*AT, "label", (-F.col("value")).alias("height"), F.coalesce("seed", F.lit(0)).cast("long").alias("seed"))
    return spilled(rows, "label")
