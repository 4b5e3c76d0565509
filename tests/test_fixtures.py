"""Operators on instances small enough to work out by hand."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import special as P
from lattica.model import Scale, SpatialNetwork
from lattica.operators import community as C
from lattica.operators import edges as E
from lattica.operators import graph as G
from lattica.operators import hull
from lattica.operators import identity as D
from lattica.operators import spatial as S
from lattica.operators import stats as T
from lattica.operators import tracing as R
from lattica.operators import voxels as V
from lattica.sources import tiff

SMALL = [(1, 2, 5), (2, 1, 6), (2, 3, 5), (3, 1, 0), (4, 5, 7), (5, 6, 7), (6, 6, 0)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(SMALL, "node_a long, node_b long, edge_c long")


def table(df, *names):
    return {tuple(r[n] for n in names[:-1]) if len(names) > 2 else r[names[0]]: r[names[-1]] for r in df.collect()}


def test_weights_and_degrees(small):
    g = E.collapse(small)
    assert table(g, "src", "dst", "weight") == {(1, 2): 2, (2, 3): 1, (1, 3): 1, (4, 5): 1, (5, 6): 1, (6, 6): 1}
    assert table(E.degrees(g), "id", "degree") == {1: 3, 2: 3, 3: 2, 4: 1, 5: 2, 6: 3}
    assert sum(table(E.degrees(g), "id", "degree").values()) == 2 * sum(table(g, "src", "dst", "weight").values())


def test_components_triangles_bridges(small):
    g = E.collapse(small.where("node_a <> node_b"))
    assert table(G.components(g), "id", "component") == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert table(G.triangles(g), "id", "triangles") == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}
    assert {(r.src, r.dst) for r in G.bridges(g).collect()} == {(4, 5), (5, 6)}
    assert E.trunk(small).first().trunk == 5
    assert table(G.core_numbers(g), "id", "core") == {1: 2, 2: 2, 3: 2, 4: 1, 5: 1, 6: 1}


def brandes(pairs, n):
    near = [set() for _ in range(n)]
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out, load = np.zeros(n), np.zeros(n)
    for s in range(n):
        dist, paths, order, todo = {s: 0}, {s: 1}, [], [s]
        while todo:
            order += todo
            nxt = []
            for v in todo:
                for w in near[v]:
                    if w not in dist:
                        dist[w], paths[w] = dist[v] + 1, 0
                        nxt.append(w)
                    if dist[w] == dist[v] + 1:
                        paths[w] += paths[v]
            todo = nxt
        dep, flow = dict.fromkeys(order, 0.0), dict.fromkeys(order, 0.0)
        for w in reversed(order):
            before = [v for v in near[w] if dist.get(v) == dist[w] - 1]
            for v in before:
                dep[v] += paths[v] / paths[w] * (1 + dep[w])
                flow[v] += (1 + flow[w]) / len(before)
            if w != s:
                out[w] += dep[w]
                load[w] += flow[w]
    scale = 1 / ((n - 1) * (n - 2))
    return out * scale, load * scale


@pytest.fixture(scope="module")
def kite(spark):
    pairs = [(0, 1), (0, 2), (0, 3), (0, 5), (1, 3), (1, 4), (1, 6), (2, 3), (2, 5), (3, 4), (3, 5), (3, 6), (4, 6), (5, 6), (5, 7), (6, 7), (7, 8), (8, 9)]
    return pairs, spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")


def test_betweenness_and_load(kite):
    pairs, g = kite
    want, load = brandes(pairs, 10)
    got = table(G.betweenness(g), "id", "betweenness")
    assert np.allclose([got[i] for i in range(10)], want)
    got = table(G.betweenness(g, load=True), "id", "load")
    assert np.allclose([got[i] for i in range(10)], load)


def test_current_flow_and_eigenvector(kite):
    pairs, g = kite
    n = 10
    lap = np.zeros((n, n))
    for a, b in pairs:
        lap[a, b] = lap[b, a] = -1
    lap -= np.diag(lap.sum(1))
    p, want = np.linalg.pinv(lap), np.zeros(n)
    for s, t in itertools.combinations(range(n), 2):
        v = p[:, s] - p[:, t]
        through = np.zeros(n)
        for a, b in pairs:
            through[a] += abs(v[a] - v[b]) / 2
            through[b] += abs(v[a] - v[b]) / 2
        through[[s, t]] = 0
        want += through
    got = table(G.current_flow(g), "id", "current_flow")
    assert np.allclose([got[i] for i in range(n)], want * 2 / ((n - 1) * (n - 2)))
    a = np.diag(np.zeros(n))
    for x, y in pairs:
        a[x, y] = a[y, x] = 1
    w, vec = np.linalg.eigh(a)
    got = table(G.eigenvector(g), "id", "eigenvector")
    assert np.allclose([got[i] for i in range(n)], np.abs(vec[:, -1]), atol=1e-4)


def series_exp(a):
    out, term = np.eye(len(a)), np.eye(len(a))
    for k in range(1, 60):
        term = term @ a / k
        out += term
    return out


def test_connectivity_dispersion_communicability(kite):
    pairs, g = kite
    n = 10
    near = [{b for p in pairs for a, b in (p, p[::-1]) if a == v} for v in range(n)]

    def apart(s, t, gone):
        seen, todo = {s}, [s]
        while todo:
            v = todo.pop()
            new = {w for w in near[v] if w not in gone and w not in seen and not (v == s and w == t)}
            seen |= new
            todo += new
        return t not in seen

    def cut(s, t):
        others = [v for v in range(n) if v not in (s, t)]
        return (t in near[s]) + next(k for k in range(n) for gone in itertools.combinations(others, k) if apart(s, t, gone))

    got = table(G.node_connectivity(g), "id", "connectivity")
    assert got == {v: cut(*sorted(near[v])[:2]) if len(near[v]) > 1 else 0 for v in range(n)}

    def spread(u, v):
        both = near[u] & near[v]
        lone = [(s, t) for s, t in itertools.combinations(both, 2) if t not in near[s] and near[s] & near[t] & near[u] <= {v}]
        return len(lone) / len(both) if both else 0

    got = table(G.dispersion(g), "id", "dispersion")
    assert got == pytest.approx({v: sum(spread(v, w) for w in near[v]) / len(near[v]) if len(near[v]) > 1 else 0 for v in range(n)})
    a = np.zeros((n, n))
    for x, y in pairs:
        a[x, y] = a[y, x] = 1
    whole, want = series_exp(a), {}
    for r in range(n):
        rest = a.copy()
        rest[r] = rest[:, r] = 0
        without = series_exp(rest)
        want[r] = sum((whole[s, t] - without[s, t]) / whole[s, t] for s in range(n) for t in range(n) if len({s, t, r}) == 3) / ((n - 1) ** 2 - (n - 1))
    assert table(G.communicability(g), "id", "communicability") == pytest.approx(want)


def test_communities_of_two_cliques(spark):
    pairs = [(a, b, 1) for c in (range(5), range(5, 11)) for a, b in itertools.combinations(c, 2)] + [(4, 5, 1)]
    g = spark.createDataFrame(pairs, "src long, dst long, weight long")
    for found in (C.louvain(g), C.label_propagation(g)):
        com = table(found, "id", "com")
        assert com == {i: 2 if i < 5 else 1 for i in range(11)}
    assert -0.5 <= C.modularity(g, C.louvain(g)) <= 1


def test_centroids_radius_and_nearest(spark):
    c = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 0, 3), (3, 0, 4, 0), (4, 10, 10, 10)], "id long, z int, y int, x int")
    assert {(r.node_a, r.node_b) for r in S.proximity_network(c, 4.0).collect()} in ({(1, 2), (1, 3)}, {(2, 1), (3, 1)}, {(1, 2), (3, 1)}, {(2, 1), (1, 3)})
    near = table(S.nearest_distances(c, c), "id", "dist")
    assert near == pytest.approx({1: 3.0, 2: 3.0, 3: 4.0, 4: math.sqrt(236)})
    rs = S.radii((20.0, 20.0, 20.0), 1.0)
    k = [r.k for r in S.ripley_k(c, c, rs, 8000.0).orderBy("r").collect()]
    assert k == sorted(k)


def test_cube(spark):
    v = spark.createDataFrame([(z, y, x, 1) for z in (0, 1) for y in (0, 1) for x in (0, 1)], "z int, y int, x int, label long")
    assert table(V.volumes(v), "id", "volume") == {1: 8.0}
    assert table(V.exposed(v), "id", "area") == {1: 24.0}
    assert V.sphericity(v).first().sphericity == pytest.approx(math.pi ** (1 / 3) * 48 ** (2 / 3) / 24)
    assert tuple(V.centroids(v).first())[1:] == (0, 0, 0)
    assert V.connected(v).select("label").distinct().count() == 1
    assert V.erode(v, 1.0).count() == 0 and V.dilate(v, 0.0, (3, 3, 3)).count() == 8
    assert V.radii(v).first().radius == pytest.approx(1.0)


def test_thinning_keeps_pieces_and_holes(spark):
    bar = [(0, y, x, 1) for y in range(3) for x in range(9)]
    ring = [(5, y, x, 1) for y in range(5) for x in range(5) if not (1 < y < 3 and 1 < x < 3)]
    v = spark.createDataFrame(bar + ring, "z int, y int, x int, label long")
    t = V.thin(v).toPandas()
    assert t.label.nunique() == 2 and len(t[t.z == 0]) < 27 and len(t[t.z == 5]) >= 4
    holes = V.fill_holes(v.where("z = 5")).toPandas()
    assert (holes[["z", "y", "x"]] == [5, 2, 2]).all(axis=1).any()


def test_identities(spark):
    ids = spark.createDataFrame([(1, ["A"]), (2, ["A", "B"]), (3, ["B"]), (4, [])], "id long, ids array<string>")
    coms = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2)], "id long, com long")
    assert table(D.composition(coms, ids), "com", "identity", "share") == {(1, "A"): 1.0, (1, "B"): 0.5, (2, "A"): 0.0, (2, "B"): 0.5}
    e = spark.createDataFrame([(1, 2, 0), (1, 3, 0), (2, 3, 0)], "node_a long, node_b long, edge_c long")
    assert [(r.node_a, r.node_b) for r in E.prune_same(e, ids).collect()] == [(1, 3)]
    assert {(r.node_a, r.node_b) for r in E.prune_same(e, ids, "A").collect()} == {(1, 3), (2, 3)}


def long(spark, groups):
    return spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "column string, value double")


def test_statistics(spark):
    u = T.mann_whitney(long(spark, {"x": [1, 2, 3], "y": [4, 5, 6]}), "x", "y")
    assert (u["u"], u["mean_rank_a"], u["mean_rank_b"]) == (0, 2, 5) and u["p"] == pytest.approx(0.1)
    a = T.anova(long(spark, {"x": [1, 2, 3], "y": [2, 3, 4]}))
    assert (a["f"], a["df_between"], a["df_within"]) == (pytest.approx(1.5), 1, 4) and a["p"] == pytest.approx(0.2878641, abs=1e-6)
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 20 + [("b", "y")] * 10
    c = T.chi_square(spark.createDataFrame(rows, "a string, b string"), "a", "b")
    assert c["chi2"] == pytest.approx(5.4) and c["dof"] == 1 and c["p"] == pytest.approx(0.0201368, abs=1e-6)


def test_distribution_functions():
    assert P.t_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert P.chi2_p(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert P.f_p(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert P.normal_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    w, p = P.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005) and p < 0.01


def test_tiff_pages():
    pages = [np.arange(12, dtype=np.uint16).reshape(3, 4), np.full((3, 4), 70000, np.uint32), np.ones((2, 2), np.float32)]
    for compress in (False, True):
        assert all((a == b).all() for a, b in zip(tiff.decode(tiff.encode(pages, compress)), pages))


def test_pixel_features_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(0)
    img = spark.createDataFrame([(0, y, x, float(rng.random())) for y in range(20) for x in range(20)], "z int, y int, x int, value double")
    get = lambda chunk: {(r.y, r.x): r.features for r in R.pixel_features(img, (1, 20, 20), chunk, halo=20).collect()}
    a, b = get(20), get(10)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_session_round_trip(spark, small, tmp_path):
    n = SpatialNetwork(edges=small, scale=Scale(0.5, 2.0), shape=(1, 2, 3))
    n.save(f"file://{tmp_path}")
    m = SpatialNetwork.load(spark, f"file://{tmp_path}")
    assert m.edges.count() == 7 and m.scale == n.scale and m.shape == n.shape and m.communities is None
    assert n.put(communities=small, edges=small).communities is small and n.put(edges=small).communities is None


def test_random_networks(spark, small):
    many = spark.createDataFrame([(i, (i * 7 + 3) % 40 + 50, 0) for i in range(40)], "node_a long, node_b long, edge_c long")
    r = E.random_equivalent(many)
    assert r.count() == 40 and r.where("node_a = node_b").count() == 0
    s = E.random_equivalent(many, simple=True)
    assert s.count() == s.select(F.least("node_a", "node_b"), F.greatest("node_a", "node_b")).distinct().count() == 40


def solid(spark, places, label=1):
    return spark.createDataFrame([(*map(int, p), label) for p in sorted(places)], "z int, y int, x int, label long")


def ball(at, r):
    n = int(r) + 1
    return {(at[0] + z, at[1] + y, at[2] + x) for z in range(-n, n + 1) for y in range(-n, n + 1) for x in range(-n, n + 1) if z * z + y * y + x * x <= r * r}


def test_components_in_rounds(spark, monkeypatch):
    from lattica import helpers

    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(300 - i, 299 - i) for i in range(0, 40, 2)] + [(50, 50)]
    df = spark.createDataFrame(links, "node_a long, node_b long").repartition(5)
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)} | {50: 50} | {i: i - (i + 1) % 2 for i in range(261, 301)}
    for at_once, last in ((1 << 20, 1 << 18), (3, 0)):
        monkeypatch.setattr(helpers, "AT_ONCE", at_once)
        monkeypatch.setattr(helpers, "LAST", last)
        assert table(helpers.components(df), "id", "component") == want


def test_connected_in_blocks(spark):
    rng = np.random.default_rng(2)
    places = {tuple(p) for p in rng.integers(0, 9, (170, 3))}
    v = solid(spark, places)
    for full, near in ((True, lambda d: max(d) == 1), (False, lambda d: sum(d) == 1)):
        todo, want = set(places), []
        while todo:
            piece, stack = set(), [min(todo)]
            todo.discard(stack[0])
            while stack:
                p = stack.pop()
                piece.add(p)
                new = {q for q in todo if near([abs(a - b) for a, b in zip(p, q)])}
                todo -= new
                stack += new
            want.append(frozenset(piece))
        for side in (64, 3):
            found = {}
            for r in V.connected(v, full, side).collect():
                found.setdefault(r.label, set()).add((r.z, r.y, r.x))
            assert [frozenset(found[i]) for i in sorted(found)] == want


def test_depths_are_least_distances(spark):
    rng = np.random.default_rng(4)
    places = {tuple(p) for p in rng.integers(0, (5, 6, 7), (150, 3))}
    outside = [p for p in itertools.product(range(-1, 6), range(-1, 7), range(-1, 8)) if p not in places]
    for scale, flat in ((Scale(1.0, 2.0), False), (Scale(1.0, 1.0), True)):
        got = {(r.z, r.y, r.x): r.depth for r in V.depths(solid(spark, places), scale, flat).collect()}
        for p, d in got.items():
            assert d == pytest.approx(min(math.dist([a * k for a, k in zip(p, (scale.z, 1, 1))], [b * k for b, k in zip(q, (scale.z, 1, 1))]) for q in outside if not flat or q[0] == p[0]))


def test_watersheds(spark):
    a, b = ball((6, 6, 6), 4), ball((6, 6, 12), 4)
    got = {(r.z, r.y, r.x): r.label for r in V.flood(solid(spark, a | b | {(0, 0, 30)}), smallest=3.0).collect()}
    assert set(got) == a | b and len(set(got.values())) == 2
    assert {got[p] for p in a if p[2] < 8} == {got[6, 6, 6]} != {got[p] for p in b if p[2] > 10} == {got[6, 6, 12]}
    bump = lambda p: sum(100 * math.exp(-math.dist(p, c) ** 2 / 8) for c in ((6, 6, 6), (6, 6, 12)))
    rows = [(*p, bump(p) if bump(p) > 5 else 0.0) for p in itertools.product(range(13), range(13), range(19))]
    image = spark.createDataFrame(rows, "z int, y int, x int, value double")
    got = {(r.z, r.y, r.x): r.label for r in R.grey_watershed(image, 50.0, 2).collect()}
    assert set(got) == {p[:3] for p in rows if p[3] > 0} and {got[p] for p in got if p[2] < 9} == {1} and {got[p] for p in got if p[2] > 9} == {2}
    flat = solid(spark, a | b).withColumn("value", F.lit(1.0))
    assert R.grey_watershed(flat, 2.0, 3).select("label").distinct().count() == 2


def test_removable_places_by_flood_fill():
    spots = list(itertools.product((-1, 0, 1), repeat=3))
    near = {"touch": lambda p, q: max(abs(a - b) for a, b in zip(p, q)) == 1, "share": lambda p, q: sum(abs(a - b) for a, b in zip(p, q)) == 1}

    def pieces(cells, how):
        todo, out = set(cells), []
        while todo:
            piece, stack = [], [todo.pop()]
            while stack:
                p = stack.pop()
                piece.append(p)
                new = {q for q in todo if near[how](p, q)}
                todo -= new
                stack += new
            out.append(piece)
        return out

    rng = np.random.default_rng(1)
    patch = rng.random((600, 27)) < rng.choice([0.15, 0.3, 0.6, 0.85], (600, 1))
    for row, got in zip(patch, V.removable(patch)):
        own = [p for p, v in zip(spots, row) if v and any(p)]
        free = [p for p, v in zip(spots, row) if not v and 0 < sum(map(abs, p)) < 3]
        faces = [x for x in pieces(free, "share") if any(sum(map(abs, p)) == 1 for p in x)]
        assert got == (len(own) > 1 and len(pieces(own, "touch")) == 1 and len(faces) == 1)


def test_thin_leaves_nothing_to_remove(spark):
    places = ball((6, 6, 6), 4) | {(6, 6, x) for x in range(6, 20)} | {(6, y, 19) for y in range(6, 15)}
    left = {(r.z, r.y, r.x) for r in V.thin(solid(spark, places)).collect()}
    assert left < places and {(6, 14, 19)} <= left and V.connected(solid(spark, left)).select("label").distinct().count() == 1
    patch = np.array([[(z + a, y + b, x + c) in left for a, b, c in itertools.product((-1, 0, 1), repeat=3)] for z, y, x in left])
    assert not V.removable(patch).any()


def test_hull_by_triangles(spark):
    rng = np.random.default_rng(3)
    pts = [tuple(map(int, p)) for p in rng.integers(0, 12, (9, 2))]
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    def inside(p):
        for t in itertools.combinations(pts, 3):
            s = [side(t[i], t[(i + 1) % 3], p) for i in range(3)]
            if (min(s) >= 0 or max(s) <= 0) and any(s):
                return True
        return False

    want = {(2, *p) for p in itertools.product(range(12), repeat=2) if inside(p)}
    assert {(r.z, r.y, r.x) for r in hull.filled(solid(spark, {(2, *p) for p in pts})).collect()} == want


def test_branches_and_trimming(spark):
    long = {(0, 0, x) for x in range(12)} | {(0, y, 6) for y in range(1, 8)} | {(0, -1, 3)}
    v = solid(spark, long)
    joints = {(r.z, r.y, r.x) for r in V.branch_points(v).collect()}
    assert (0, 0, 6) in joints
    left = {(r.z, r.y, r.x) for r in V.trimmed_branches(v, 2).collect()}
    assert left <= long and {(0, 0, 0), (0, 0, 11), (0, 7, 6)} <= left
    arms = V.branches(v, (1, 10, 14)).toPandas()
    name = {(r.y, r.x): r.label for r in arms.itertuples()}
    assert len({name[0, 0], name[0, 11], name[7, 6]}) == 3 and len(arms) == len(long)


def test_filaments_join_across_gaps_in_line(spark):
    line = [(0, 5, x, 1) for x in range(10)] + [(0, 5, x, 2) for x in range(13, 25)] + [(0, 25, x, 3) for x in range(10)] + [(9, 9, 9, 4)]
    v = spark.createDataFrame(line, "z int, y int, x int, label long")
    assert {(r.label_a, r.label_b) for r in R.stitches(v, 5.0).collect()} == {(1, 2)}
    depth = v.select("z", "y", "x", F.lit(2.0).alias("depth"))
    got = R.trace(v, 4.0, 8, depth).toPandas()
    assert sorted(got.groupby("label").size().items()) == [(1, 22), (3, 10)]
    k = {(r.y, r.x): r for r in R.kernels(v.where("label < 3")).collect()}
    assert k[5, 0].is_end and not k[5, 4].is_end and k[5, 0].vx == pytest.approx(1) and k[5, 9].vx == pytest.approx(-1)


def test_leiden_pieces_are_connected(spark):
    rng = np.random.default_rng(7)
    pairs = {tuple(sorted(p)) for c in range(4) for p in rng.integers(12 * c, 12 * c + 12, (40, 2)).tolist() if p[0] != p[1]} | {tuple(sorted(p)) for p in rng.integers(0, 48, (14, 2)).tolist() if p[0] != p[1]}
    g = spark.createDataFrame([(*p, 1) for p in sorted(pairs)], "src long, dst long, weight long")
    found = C.leiden(g)
    com = table(found, "id", "com")
    for c in set(com.values()):
        own = {i for i in com if com[i] == c}
        seen, todo = set(), [min(own)]
        while todo:
            i = todo.pop()
            seen.add(i)
            todo += [b for p in pairs for a, b in (p, p[::-1]) if a == i and b in own and b not in seen]
        assert seen == own
    assert C.modularity(g, found) > 0.45


def test_threshold_network(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3)) * [1, 10, 100] + [0, 5, -50]
    rows = [(i, *map(float, p), float(p[0] + abs(p[1]) / 10), float(p[2] / 50 - p[0])) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, s double, t double")
    got = R.predict_thresholds(df.where("id < 450"), ["a", "b", "c"], ["s", "t"], df.where("id >= 450"), epochs=120).toPandas()
    for k in "st":
        assert ((got[k] - got[f"predicted_{k}"]) ** 2).mean() < 0.05 * got[k].var()


def test_clusters_of_blobs(spark):
    from lattica.operators import cluster as K

    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=2) * 0.2 + c)) for i, c in enumerate([(0, 0)] * 30 + [(5, 0)] * 20 + [(0, 5)] * 10)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    want = {i: 1 if i < 30 else 2 if i < 50 else 3 for i in range(60)}
    assert table(K.kmeans(df, ["a", "b"], 3, starts=2), "id", "cluster") == want
    assert table(K.auto_kmeans(df, ["a", "b"], most=5), "id", "cluster") == want


def test_scrambled_places_are_the_places(spark):
    c = spark.createDataFrame([(i, i % 3, i * i, -i) for i in range(40)], "id long, z int, y int, x int")
    s = S.scrambled(c).collect()
    assert sorted(r.id for r in s) == list(range(40)) and sorted(tuple(r)[1:] for r in s) == sorted(tuple(r)[1:] for r in c.collect())
