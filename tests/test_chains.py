"""Chains against walks, cylinders against balls drawn one by one."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import chains as C


def table(spark, rows):
    return spark.createDataFrame([(*map(int, p), int(l)) for p, l in rows], "z int, y int, x int, label long").repartition(3)


def graph(rows):
    own = dict(rows)
    near = lambda p: [tuple(np.add(p, o)) for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]
    return {p: [q for q in map(lambda q: tuple(map(int, q)), near(p)) if own.get(q) == l] for p, l in own.items()}


def walked(rows):
    """The chains, each as its list of voxels from end to end, walked one step at a time."""
    g, found = graph(rows), []
    ends = {p for p, n in g.items() if len(n) != 2}
    for c in sorted(ends):
        for nb in g[c]:
            way = [c, nb]
            while way[-1] not in ends:
                way.append(next(q for q in g[way[-1]] if q != way[-2]))
            found.append(way)
    return found


def key(p):
    return ((p[0] + (1 << 20)) << 42) + ((p[1] + (1 << 20)) << 21) + p[2] + (1 << 20)


@pytest.fixture(scope="module")
def skeleton():
    line = [((0, 0, x), 1) for x in range(40)] + [((0, y, 20), 1) for y in range(1, 9)]
    ring = [((5, 3 * round(math.cos(t) * 4), 3 * round(math.sin(t) * 4)), 2) for t in np.linspace(0, 6.3, 5)]
    diamond = {(9, y, x) for y in range(9) for x in range(9) if abs(y - 4) + abs(x - 4) == 4}  # a ring without an end
    tail = {(12, y, x) for y in range(9) for x in range(9) if abs(y - 4) + abs(x - 4) == 4} | {(12, 4, x) for x in range(9, 15)}
    other = [((0, 0, 40 + x), 3) for x in range(3)] + [((15, 15, 15), 4)]
    return list(dict(line + ring + [(p, 5) for p in diamond] + [(p, 6) for p in tail] + other + [((-3, 7, -x), 7) for x in range(6)]).items())


def test_ranks_are_steps_of_a_walk(spark, skeleton):
    want = {}
    for way in walked(skeleton):
        if len(way) > 2:
            a, b = (key(way[0]), key(way[1])), (key(way[-1]), key(way[-2]))
            if a < b:
                want |= {key(p): (*a, *b, i, len(way) - 1) for i, p in enumerate(way) if 0 < i < len(way) - 1}
    got = {r.v: (r.end_a, r.first_a, r.end_b, r.first_b, r.rank, r.length) for r in C.ranked(table(spark, skeleton)).collect()}
    assert got == want and len(want) > 50
    assert C.ranked(table(spark, skeleton).where("false")).count() == 0
    back = table(spark, skeleton).select("z", "y", "x", C.place_key([F.col(a) for a in C.AT]).alias("k")).select(F.struct("z", "y", "x").alias("p"), F.struct(*C.places("k")).alias("q"))
    assert back.where("p <> q").count() == 0


@pytest.mark.parametrize("spacing", [1, 3, 7])
def test_kernels_follow_one_another(spark, skeleton, spacing):
    want = set()
    for way in walked(skeleton):
        if len(way) == 2 or (key(way[0]), key(way[1])) < (key(way[-1]), key(way[-2])):
            k = [p for i, p in enumerate(way) if i % spacing == 0 or i == len(way) - 1]
            want |= {tuple(sorted((key(p), key(q)))) for p, q in zip(k, k[1:])}
    assert {(r.u, r.v) for r in C.kernel_links(table(spark, skeleton), spacing).collect()} == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    made, settle = [], C.settle
    monkeypatch.setattr(C, "settle", lambda df, name="": made.append(name) or settle(df, name))
    n = 3000
    rows = spark.range(n).select(F.lit(0).alias("z"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), F.lit(1).cast("long").alias("label"))
    got = C.ranked(rows).agg(F.count("*"), F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.min("length")).first()
    assert tuple(got) == (n - 2, 1, n - 2, n - 2, n - 1)
    assert made.count("arcs") <= 2 + math.ceil(math.log2(n))


def balls(segments, shape):
    """Every ball of every cylinder, place by place."""
    out = {}
    for label, a, b, ra, rb in sorted(segments):
        d = math.dist(a, b)
        n = max(3, int(d * (3.0 if abs(ra - rb) > 2 else 2.0)))
        drawn = [(a, max(ra, rb))] if d < 0.5 else [(np.array(a) * (1 - t) + np.array(b) * t, ra * (1 - t) + rb * t) for t in np.linspace(0, 1, n)]
        for middle, radius in drawn:
            m, r = [int(c) for c in middle], round(radius * 2) / 2
            k = int(r)
            for o in itertools.product(range(-k, k + 1), repeat=3):
                p = tuple(c + s for c, s in zip(m, o))
                if sum(s * s for s in o) <= r * r and all(0 <= c < s for c, s in zip(p, shape)):
                    out.setdefault(p, label)
    return out


def test_tapered_cylinders(spark):
    shape, rng = (14, 20, 25), np.random.default_rng(1)
    segments = [(7, (2, 3, 4), (2, 3, 4), 1.5, 2.5), (3, (0, 0, 0), (13, 19, 24), 0.5, 3.9), (5, (5, 5, 5), (5, 5, 6), 0.0, 0.2)]
    segments += [(int(i), *(tuple(map(int, rng.integers(0, shape))) for _ in "ab"), *map(float, rng.uniform(0, 4, 2))) for i in range(10, 16)]
    point = "struct<z:int,y:int,x:int>"
    df = spark.createDataFrame(segments, f"label long, a {point}, b {point}, ra double, rb double").repartition(3)
    got = {(r.z, r.y, r.x): r.label for r in C.tapered(df, shape).collect()}
    assert got == balls(segments, shape)
    assert C.tapered(df.where("false"), shape).count() == 0


def test_bodies_along_a_skeleton(spark):
    rows = [((5, 5, x), 4) for x in range(3, 18)]
    depth = spark.createDataFrame([(5, 5, x, 1.0 + (x > 10)) for x in range(3, 18)], "z int, y int, x int, depth double")
    got = {(r.z, r.y, r.x): r.label for r in C.bodies(table(spark, rows), depth, (10, 10, 20), spacing=4).collect()}
    marks = [3, 7, 11, 15, 17]
    assert got == balls([(4, (5, 5, p), (5, 5, q), 1.0 + (p > 10), 1.0 + (q > 10)) for p, q in zip(marks, marks[1:])], (10, 10, 20))
