"""Operators whose results are random, chosen or files: what must hold of them whatever was drawn."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from lattica import inputs as I
from lattica.operators import edges as E
from lattica.operators import graph as G
from lattica.operators import identity as D
from lattica.operators import layout as L
from lattica.operators import voxels as V
from lattica.plans import report as R

SF = "/root/testdata/sf0.001"


def test_one_identity_each_is_one_of_the_own(spark):
    rows = [(i, [f"x{j}" for j in range(i % 4)]) for i in range(400)] + [(1000, None)]
    own = dict(rows)
    df = spark.createDataFrame(rows, "id long, ids array<string>").repartition(3)
    once, again = ({r.id: r.ids for r in D.one_each(df).collect()} for _ in range(2))
    assert once == again and set(once) <= set(own)
    for i, ids in once.items():
        assert len(ids or []) == (1 if own[i] else 0) and set(ids or []) <= set(own[i] or [])
    # of nodes with three identities each one is drawn about as often
    drawn = Counter(once[i][0] for i in own if own[i] and len(own[i]) == 3)
    assert set(drawn) == {"x0", "x1", "x2"} and min(drawn.values()) > 15


def test_report_has_every_metric_of_its_graph(spark, tmp_path):
    links = [(1, 2, 1), (2, 3, 2), (3, 1, 1), (3, 4, 1), (4, 5, 1), (7, 8, 1)]
    graph = spark.createDataFrame(links, "src long, dst long, weight long")
    done = R.report(graph, f"file://{tmp_path}")
    assert sorted(done) == sorted(R.METRICS) and len(done) == 17 == len({p.name for p in tmp_path.iterdir()})
    read = lambda name: spark.read.option("header", True).csv(f"file://{tmp_path}/{name}")
    assert {(int(r.id), int(r.triangles)) for r in read("triangle_count.csv").collect()} == {(1, 1), (2, 1), (3, 1), (4, 0), (5, 0), (7, 0), (8, 0)}
    harmonic = {int(r.id): float(r.harmonic) for r in read("harmonic_centrality.csv").collect()}
    assert harmonic[5] == pytest.approx(1 + 1 / 2 + 2 / 3) and harmonic[7] == 1
    bridges = {tuple(sorted(map(int, list(r)[:2]))) for r in read("bridges.csv").collect()}
    assert bridges == {(3, 4), (4, 5), (7, 8)}
    for name in done:
        rows = read(name)
        assert rows.columns and rows.count() > 0, name
    some = R.report(graph, f"file://{tmp_path}/some", ["kcore.csv"])
    assert some == ["kcore.csv"] and [p.name for p in (tmp_path / "some").iterdir()] == some


def test_springs_draw_neighbours_together(spark):
    """Two dense groups with one link between: nodes of a group end nearer to each other than to the other group, from a ring that mixes them."""
    group = {i: i % 2 for i in range(24)}
    links = [(a, b, 1) for a, b in itertools.combinations(range(24), 2) if group[a] == group[b]] + [(0, 1, 1)]
    graph = spark.createDataFrame(links, "src long, dst long, weight long")
    at = {r.id: (r.px, r.py) for r in L.spring(graph, rounds=8).collect()}
    assert set(at) == set(group) and all(map(math.isfinite, itertools.chain(*at.values())))
    start = {r.id: (r.px, r.py) for r in L.ring(G.vertices(graph)).collect()}

    def ratio(p):
        mean = lambda same: np.mean([math.dist(p[a], p[b]) for a, b in itertools.combinations(p, 2) if (group[a] == group[b]) == same])
        return mean(True) / mean(False)

    assert ratio(at) < ratio(start)
    linked = lambda p: np.mean([math.dist(p[a], p[b]) for a, b, _ in links])
    assert linked(at) < linked(start)


def test_degrees_of_the_flagship_query(spark):
    """Every order adds each of its suppliers to each other one's neighbours."""
    found = {}
    for r in I.occurrences(spark, SF).distinct().collect():
        found.setdefault(r.edge, set()).add(r.node)
    want = Counter()
    for nodes in found.values():
        for n in nodes:
            want[n] += len(nodes) - 1
    got = {r.id: r.degree for r in E.degrees(E.collapse(I.edges(spark, SF))).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_the_valley_of_sizes_parts_specks_from_bodies(spark):
    """Forty specks of one to three voxels and six bars of about forty: the histogram of sizes has a gap between the two."""
    rows = [(0, 4 * i, 4 * j) for i in range(8) for j in range(5)]
    specks = [(z, y, x + k) for n, (z, y, x) in enumerate(rows) for k in range(1 + n % 3)]
    bars = [(5, 3 * i, x) for i in range(6) for x in range(38 + i)]
    df = spark.createDataFrame([(*p, 1) for p in specks + bars], "z int, y int, x int, label long").repartition(3)
    kept = {(r.z, r.y, r.x) for r in V.peaks_filter(df, peak=2).collect()}
    assert set(bars) <= kept and len(kept) < len(specks) + len(bars)
    one = df.where("z = 5 AND y = 0")
    assert V.peaks_filter(one).count() == 38
