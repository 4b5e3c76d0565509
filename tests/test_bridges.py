"""Bridges against taking out one link after another, in one task and level by level, from the forests of many small stretches."""

import itertools

import numpy as np
import pytest

from lattica.operators import graph as G


def parts(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return len({find(x) for x in list(root)}), set(root)


def plain(links):
    out = set()
    nodes = parts(links)[1]
    for k, link in enumerate(links):
        rest = links[:k] + links[k + 1 :]
        n, seen = parts(rest)
        if n + len(nodes - seen) > parts(links)[0]:
            out.add(link)
    return out


def some_graph(seed):
    """A sparse random graph, a long path, a ring with a tail, two dense groups with one link between them."""
    rng = np.random.default_rng(seed)
    links = {tuple(sorted(map(int, p))) for p in rng.integers(0, 60, (55, 2)) if p[0] != p[1]}
    links |= {(100 + i, 101 + i) for i in range(15)} | {(200 + i, 200 + (i + 1) % 9) for i in range(8)} | {(200, 208), (204, 230), (230, 231)}
    links |= set(itertools.combinations(range(300, 307), 2)) | set(itertools.combinations(range(310, 316), 2)) | {(303, 312)}
    return sorted(tuple(sorted(p)) for p in links)


@pytest.mark.parametrize("last,at_once", [(1 << 18, 1 << 20), (0, 9), (1 << 18, 9)])
def test_bridges(spark, monkeypatch, last, at_once):
    monkeypatch.setattr(G, "LAST", last)
    monkeypatch.setattr(G, "AT_ONCE", at_once)
    links = some_graph(last % 7 + at_once % 5)
    want = plain(links)
    heavy = sorted(want)[::3]
    rows = [(a, b, 2 if (a, b) in heavy else 1) for a, b in links] + [(5, 5, 1)]
    df = spark.createDataFrame(rows, "src long, dst long, weight long").repartition(3)
    assert {(r.src, r.dst) for r in G.bridges(df).collect()} == want - set(heavy) and len(want) > 20
    assert G.bridges(df.where("false")).count() == 0


def test_forests_keep_cuts_of_one_link(spark, monkeypatch):
    monkeypatch.setattr(G, "AT_ONCE", 40)
    links = list(itertools.combinations(range(40), 2)) + [(39, 40)]
    kept = [tuple(r) for r in G._certified(spark.createDataFrame(links, "a long, b long").repartition(2)).collect()]
    assert set(kept) <= set(links) and plain(sorted(kept)) == {(39, 40)}
    i, j = (np.array(x) for x in zip(*itertools.combinations(range(30), 2)))
    assert len(G._forest(i, j, 30)) == 29
