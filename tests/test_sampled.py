"""Closeness from a sample of sources against searches from all nodes."""

import math
from collections import deque

from lattica.operators import graph as G


def around(links, start):
    near, seen, todo = {}, {start: 0}, deque([start])
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while todo:
        x = todo.popleft()
        for y in near[x] - seen.keys():
            seen[y] = seen[x] + 1
            todo.append(y)
    return seen


GRID = [(12 * y + x, 12 * y + x + 1) for y in range(12) for x in range(11)] + [(12 * y + x, 12 * y + x + 12) for y in range(11) for x in range(12)]
LINKS = GRID + [(1000, 1001), (1001, 1002), (1002, 1003), (2000, 2000)]


def means():
    found = {v: around(LINKS, v) for v in {v for pair in LINKS for v in pair}}
    return {v: sum(d.values()) / len(d) for v, d in found.items()}


def test_all_sources_are_exact(spark):
    graph = spark.createDataFrame([(a, b, 1) for a, b in LINKS], "src long, dst long, weight long")
    want, mean = {r.id: r.closeness for r in G.closeness(G.distances(graph)).collect()}, means()
    got = {r.id: r for r in G.sampled_closeness(graph, 1000).collect()}
    assert got.keys() == want.keys() == mean.keys()
    assert all(r.error == 0 and math.isclose(r.mean_distance, mean[k]) and math.isclose(r.closeness, want[k]) for k, r in got.items())


def test_a_sample_is_within_its_error(spark):
    graph = spark.createDataFrame([(a, b, 1) for a, b in LINKS], "src long, dst long, weight long")
    got, want = {r.id: r for r in G.sampled_closeness(graph, 60).collect()}, means()
    assert got.keys() == want.keys() and all(r.error == 0 for k, r in got.items() if k >= 1000) and all(r.error > 0 for k, r in got.items() if k < 1000)
    assert all(abs(r.mean_distance - want[k]) <= r.error + 1e-9 for k, r in got.items())
    assert max(abs(r.mean_distance - want[k]) for k, r in got.items()) < 2  # and near, beside a width of 22
    again = {r.id: tuple(r) for r in G.sampled_closeness(graph.repartition(3), 60).collect()}
    assert again == {k: tuple(r) for k, r in got.items()}


def test_an_empty_graph(spark):
    assert G.sampled_closeness(spark.createDataFrame([], "src long, dst long, weight long")).count() == 0
