"""Graph analytics on graphs (src, dst, weight); paths, triangles and components ignore weights and self-loops.

Distances, path counts and dependencies are tables of (source, node) rows that grow one breadth-first level at a time; a source is
never gathered anywhere. All pairs cost nodes times edges, so large graphs give a sample of sources. Dense algebra per component
(communicability, current flow, dispersion, vertex cuts) runs in one task for each component, which bounds the component.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..helpers import components as _components
from ..helpers import AT_ONCE, LAST, least_linked, settle, until_stable
from .edges import degrees, neighbours


#: Pairs of a component up to which a metric that needs all of it at once is computed.
MOST_PAIRS = 5_000_000
#: Rows of a matrix that are sorted at a time.
ROWS = 256


def simple(graph: DataFrame) -> DataFrame:
    """Both directions of every pair, without self-loops: (a, b)."""
    return neighbours(graph).where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()


def vertices(graph: DataFrame) -> DataFrame:
    return graph.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def components(graph: DataFrame) -> DataFrame:
    """(id, component), numbered by the smallest id."""
    return _components(graph, "src", "dst")


def largest_component(graph: DataFrame, containing: int | None = None) -> DataFrame:
    """Nodes of the largest component (the first of equals), or of the one with a node."""
    c = components(graph)
    if containing is not None:
        return c.join(c.where(F.col("id") == containing).select("component"), "component", "left_semi").select("id")
    return largest_of(c)


def largest_of(parts: DataFrame) -> DataFrame:
    most = parts.groupBy("component").agg(F.count("*").alias("n")).agg(F.min_by("component", F.struct((-F.col("n")).alias("k"), "component")).alias("component"))
    return parts.join(F.broadcast(most), "component", "left_semi").select("id")


def without_small_components(graph: DataFrame, least: int | None = None) -> DataFrame:
    """The graph without components of fewer than `least` nodes, a tenth of the largest if None."""
    c = components(graph)
    sizes = c.groupBy("component").agg(F.count("*").alias("n"))
    bound = F.lit(float(least)) if least is not None else F.col("most") * 0.1
    keep = sizes.crossJoin(F.broadcast(sizes.agg(F.max("n").alias("most")))).where(F.col("n") >= bound).select("component")
    return graph.join(c.join(keep, "component", "left_semi").select(F.col("id").alias("src")), "src", "left_semi")


def distances(graph: DataFrame, sources: DataFrame | None = None, most: int | None = None, counts: bool = False) -> DataFrame:
    """(s, t, d) for every node t reached from a source s, d = 0 for itself; all nodes are sources if None. With counts also paths, the
    number of shortest paths."""
    links = settle(simple(graph), "links")
    start = (vertices(graph) if sources is None else sources.select("id").distinct()).select(F.col("id").alias("s"), F.col("id").alias("t"), F.lit(0).alias("d"), F.lit(1.0).alias("paths"))
    front = settle(start, "front")
    done, level = front, 0
    while most is None or level < most:
        level += 1
        step = front.join(links, F.col("t") == F.col("a")).groupBy("s", F.col("b").alias("t")).agg(F.sum("paths").alias("paths"))
        front = settle(step.join(done, ["s", "t"], "left_anti").select("s", "t", F.lit(level).alias("d"), "paths"), "front")
        if front.isEmpty():
            break
        done = done.unionByName(front)
    return done if counts else done.drop("paths")


def _times(dist: DataFrame) -> Column:
    """How many nodes a row of distances stands for: rows are (s, t, d), or (s, d, n) with n nodes at a distance."""
    return F.col("n") if "n" in dist.columns else F.lit(1)


def path_lengths(dist: DataFrame, parts: DataFrame) -> DataFrame:
    """(component, length, n, percent) over ordered pairs of different nodes."""
    rows = dist.where("d > 0").join(parts.withColumnRenamed("id", "s"), "s").groupBy("component", F.col("d").alias("length")).agg(F.sum(_times(dist)).alias("n"))
    total = rows.groupBy("component").agg(F.sum("n").alias("all"))
    return rows.join(total, "component").select("component", "length", "n", (100 * F.col("n") / F.col("all")).alias("percent"))


def closeness(dist: DataFrame) -> DataFrame:
    """(id, closeness): nodes reached over the sum of their distances, times the share of all nodes that they are."""
    n, times = F.broadcast(dist.where("d = 0").agg(F.count("*").alias("n"))), _times(dist)
    per = dist.groupBy(F.col("s").alias("id")).agg((F.sum(times) - 1).alias("r"), F.sum(F.col("d") * times).alias("total")).crossJoin(n)
    return per.select("id", F.when((F.col("total") > 0) & (F.col("n") > 1), F.col("r") / F.col("total") * F.col("r") / (F.col("n") - 1)).otherwise(0.0).alias("closeness"))


def sampled_closeness(graph: DataFrame, sample: int = 256, risk: float = 0.01) -> DataFrame:
    """(id, mean_distance, error, closeness) from breadth-first searches of some `sample` sources of each component instead of all nodes.

    Every node of a component of `sample` nodes at most is a source; of a larger one each is with a chance of sample / nodes, by a hash of its id, so
    reruns agree. mean_distance is that to the component's nodes, itself among them, and error is what it is off by at most, by Hoeffding's
    inequality, for all nodes of a component at once but for a probability of `risk`: no distance exceeds twice the least eccentricity of a source.
    Where all are sources, results are exact and the error is 0. closeness is as in `closeness`. An empty graph has no rows."""
    parts = settle(components(graph), "parts")
    dist = settle(distances(graph, sources(parts, sample)), "sampled")
    far = dist.groupBy(F.col("s").alias("id")).agg(F.max("d").alias("far"))
    return closeness_of_sample(parts, far, dist.groupBy(F.col("t").alias("id")).agg(F.avg("d").alias("mean_distance")), risk)


def sources(parts: DataFrame, sample: int) -> DataFrame:
    """(id) of about `sample` nodes of each component, all of a smaller one, by a hash of the id."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
    return parts.join(sizes, "component").where((F.col("n") <= sample) | (chance < sample / F.col("n"))).select("id")


def closeness_of_sample(parts: DataFrame, far: DataFrame, mean: DataFrame, risk: float) -> DataFrame:
    """The result of `sampled_closeness` from the greatest distance of each source and the mean distance of each node to the sources."""
    sizes = settle(parts.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    of = far.join(parts, "id").groupBy("component").agg((2 * F.min("far")).alias("span"), F.count("*").alias("k")).join(sizes, "component")
    of = of.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("nodes"))))  # one row
    per = mean.join(parts, "id").join(of, "component")
    n, mean = F.col("n"), F.col("mean_distance")
    error = F.when(F.col("k") == n, 0.0).otherwise(F.col("span") * F.sqrt(F.log(2 * n / risk) / (2 * F.col("k"))))
    close = F.when(mean > 0, (n - 1) / (mean * n) * (n - 1) / (F.col("nodes") - 1)).otherwise(0.0)
    return per.select("id", "mean_distance", error.alias("error"), close.alias("closeness"))


def harmonic(dist: DataFrame) -> DataFrame:
    return dist.groupBy(F.col("s").alias("id")).agg(F.sum(F.when(F.col("d") > 0, _times(dist) / F.col("d")).otherwise(0.0)).alias("harmonic"))


def eccentricity(dist: DataFrame, nodes: DataFrame) -> DataFrame:
    """Greatest distance from each of the given nodes."""
    return dist.join(nodes.select(F.col("id").alias("s")), "s", "left_semi").groupBy(F.col("s").alias("id")).agg(F.max("d").alias("eccentricity"))


def degree_centrality(graph: DataFrame) -> DataFrame:
    return centrality_of(degrees(graph))


def centrality_of(d: DataFrame) -> DataFrame:
    return d.crossJoin(F.broadcast(d.agg(F.count("*").alias("n")))).select("id", F.try_divide("degree", F.col("n") - 1).alias("centrality"))


def betweenness(graph: DataFrame, dist: DataFrame | None = None, per_component: bool = True, load: bool = False) -> DataFrame:
    """(id, betweenness) by Brandes: dependencies flow back from the farthest level to the sources, to each predecessor in proportion to
    its shortest paths, or, for the load, in equal parts. Normalised by the pairs of a node's component, or of the whole graph."""
    dist = settle(dist if dist is not None else distances(graph, counts=True), "paths")
    links = simple(graph)
    far = dist.agg(F.max("d")).first()[0] or 0
    flow, out = None, []
    for level in range(far, 0, -1):
        here = dist.where(F.col("d") == level)
        here = here.join(flow, ["s", "t"], "left").select("s", "t", "paths", F.coalesce("x", F.lit(0.0)).alias("x")) if flow is not None else here.select("s", "t", "paths", F.lit(0.0).alias("x"))
        up = dist.where(F.col("d") == level - 1).select("s", F.col("t").alias("u"), F.col("paths").alias("pu"))
        pairs = here.join(links, F.col("t") == F.col("a")).select("s", "t", "paths", "x", F.col("b").alias("u")).join(up, ["s", "u"])
        share = F.col("pu") / F.col("paths")
        if load:
            share = 1 / F.count("*").over(Window.partitionBy("s", "t"))
            pairs = pairs.withColumn("share", share)
            share = F.col("share")
        flow = settle(pairs.groupBy("s", F.col("u").alias("t")).agg(F.sum(share * (1 + F.col("x"))).alias("x")), "flow")
        if level > 1:
            out.append(flow)
    nodes = dist.where("d = 0").select(F.col("s").alias("id"))
    total = None
    for f in out:
        total = f if total is None else total.unionByName(f)
    sums = total.groupBy(F.col("t").alias("id")).agg(F.sum("x").alias("x")) if total is not None else nodes.select("id", F.lit(0.0).alias("x")).where("false")
    size = dist.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("n")) if per_component else nodes.crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n"))))
    scale = F.when(F.col("n") > 2, 1 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0)
    return nodes.join(sums, "id", "left").join(size, "id").select("id", (F.coalesce("x", F.lit(0.0)) * scale).alias("load" if load else "betweenness"))


def triangles(graph: DataFrame) -> DataFrame:
    """(id, triangles) for every node. Each pair is directed from its end of smaller degree, so that hubs list few neighbours."""
    links = simple(graph)
    d = links.groupBy("a").agg(F.count("*").alias("k"))
    ranked = links.join(d, "a").join(d.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b")
    out = settle(ranked.where((F.col("k") < F.col("kb")) | ((F.col("k") == F.col("kb")) & (F.col("a") < F.col("b")))).select("a", "b"), "directed")
    wedge = out.alias("x").join(out.alias("y"), F.col("x.a") == F.col("y.a")).where("x.b < y.b").select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    closed = wedge.join(out.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c")), ["b", "c"])
    per = closed.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    return vertices(graph).join(per, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def clustering(graph: DataFrame) -> DataFrame:
    d = simple(graph).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("k"))
    return triangles(graph).join(d, "id", "left").select("id", F.coalesce(F.try_divide(2 * F.col("triangles"), F.col("k") * (F.col("k") - 1)), F.lit(0.0)).alias("clustering"))


def core_numbers(graph: DataFrame) -> DataFrame:
    """(id, core): from the degrees down, each node takes the greatest h such that h of its neighbours have at least h, until none changes.
    Neighbours are counted by value first, and a node has few different values around it, however many neighbours."""
    links = settle(simple(graph), "links")
    start = links.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("core"))
    upward = F.sum("k").over(Window.partitionBy("a").orderBy(F.desc("v")))

    def step(state: DataFrame) -> DataFrame:
        counts = links.join(state.select(F.col("id").alias("b"), F.col("core").alias("v")), "b").groupBy("a", "v").agg(F.count("*").alias("k"))
        return counts.withColumn("i", upward).groupBy(F.col("a").alias("id")).agg(F.max(F.least("i", "v")).cast("long").alias("core"))

    found = until_stable(start, step)
    return vertices(graph).join(found, "id", "left").select("id", F.coalesce("core", F.lit(0)).cast("long").alias("core"))


def eigenvector(graph: DataFrame, rounds: int = 100, tolerance: float = 1e-6, at_once: int = 5) -> DataFrame:
    """(id, eigenvector): power iteration with A + I from equal parts, until the change is below tolerance times the nodes or rounds are over."""
    links = settle(simple(graph), "links")
    nodes = vertices(graph)
    n = nodes.count()
    x = settle(nodes.select("id", F.lit(1.0 / max(n, 1)).alias("v")), "vector")
    for _ in range(0, rounds, at_once):
        now = x
        for _ in range(at_once):
            own = now.unionByName(links.join(now, F.col("a") == F.col("id")).select(F.col("b").alias("id"), "v"))
            now = own.groupBy("id").agg(F.sum("v").alias("v"))
        norm = F.broadcast(now.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")))
        now = settle(now.crossJoin(norm).select("id", (F.col("v") / F.col("norm")).alias("v")), "vector")
        moved = now.join(x.withColumnRenamed("v", "o"), "id").agg(F.sum(F.abs(F.col("v") - F.col("o")))).first()[0] or 0.0
        x = now
        if moved < tolerance * n:
            break
    return x.withColumnRenamed("v", "eigenvector")


def per_component(graph: DataFrame, solve, schema: str) -> DataFrame:
    """solve(ids, i, j, w) -> columns, run for each component on its nodes and on its pairs as positions among them."""
    c = components(graph)
    rows = graph.where("src <> dst").join(c.withColumnRenamed("id", "src"), "src").select("component", "src", "dst", "weight")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_PAIRS:
            raise ValueError(f"a component has {len(pdf)} pairs, more than this metric takes in one task ({MOST_PAIRS})")
        ids = np.unique(pdf[["src", "dst"]].to_numpy())
        i, j = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])
        return pd.DataFrame(solve(ids, i, j, pdf["weight"].to_numpy(float)))

    return rows.groupBy("component").applyInPandas(run, schema)


def communicability(graph: DataFrame) -> DataFrame:
    """Communicability betweenness in each component: how much less the rest communicates without a node."""

    def solve(ids, i, j, w):
        n = len(ids)
        a = np.zeros((n, n))
        a[i, j] = a[j, i] = 1
        power = lambda m: (lambda e, v: (v * np.exp(e)) @ v.T)(*np.linalg.eigh(m))
        whole, out = power(a), np.zeros(n)
        for r in range(n):
            b = a.copy()
            b[r], b[:, r] = 0, 0
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.nan_to_num((whole - power(b)) / whole)
            ratio[r], ratio[:, r] = 0, 0
            np.fill_diagonal(ratio, 0)
            out[r] = ratio.sum()
        scale = (n - 1) ** 2 - (n - 1)
        return {"id": ids, "communicability": out / scale if scale else out}

    return per_component(graph, solve, "id long, communicability double")


def current_flow(graph: DataFrame) -> DataFrame:
    """Current-flow betweenness in each component, weights as conductances, normalised by (n - 1)(n - 2)."""

    def solve(ids, i, j, w):
        n = len(ids)
        lap = np.zeros((n, n))
        np.add.at(lap, (i, j), -w)
        np.add.at(lap, (j, i), -w)
        lap[np.arange(n), np.arange(n)] = -lap.sum(1)
        # a constant added makes the matrix regular and leaves differences of rows of the inverse what they are
        p, out, rank = np.linalg.inv(lap + np.trace(lap) / n**2), np.zeros(n), 2.0 * np.arange(n) - n + 1
        for k in range(0, len(i), ROWS):
            a, b, c = (x[k : k + ROWS] for x in (i, j, w))
            flow = np.sort((p[a] - p[b]) * c[:, None]) @ rank  # over all pairs of places the sum of differences
            np.add.at(out, a, flow)
            np.add.at(out, b, flow)
        out = out - (n - 1)  # twice what passes through: a pair that a node is an end of counts half
        return {"id": ids, "current_flow": out / ((n - 1) * (n - 2)) if n > 2 else np.zeros(n)}

    return per_component(graph, solve, "id long, current_flow double")


def _adjacency(n, i, j):
    out = [set() for _ in range(n)]
    for a, b in zip(i.tolist(), j.tolist()):
        out[a].add(b)
        out[b].add(a)
    return out


def dispersion(graph: DataFrame) -> DataFrame:
    """Mean dispersion of a node over its neighbours (0 with fewer than two): of each neighbour the pairs of common neighbours that are not
    linked and share nobody but the two, over the common ones."""

    def solve(ids, i, j, w):
        near = _adjacency(len(ids), i, j)

        def one(u, v):
            both = sorted(near[u] & near[v])
            total = 0
            for k, s in enumerate(both):
                for t in both[k + 1 :]:
                    total += t not in near[s] and not ((near[s] & near[t] & near[u]) - {u, v})
            return total / len(both) if both else 0.0

        return {"id": ids, "dispersion": [np.mean([one(u, v) for v in sorted(near[u])]) if len(near[u]) > 1 else 0.0 for u in range(len(ids))]}

    return per_component(graph, solve, "id long, dispersion double")


def node_connectivity(graph: DataFrame) -> DataFrame:
    """For each node how many nodes must go to part its first two neighbours (by id); linked neighbours count as their own cut."""

    def solve(ids, i, j, w):
        near = _adjacency(len(ids), i, j)

        def cut(s, t):
            # unit capacities through split nodes: v enters at (v, 0) and leaves at (v, 1)
            flow, used, direct = 0, defaultdict(int), t in near[s]
            while True:
                seen, todo = {(s, 1): None}, deque([(s, 1)])
                while todo and (t, 0) not in seen:
                    v, side = todo.popleft()
                    ahead = [(x, 0) for x in near[v] if not (v == s and x == t)] if side else [(v, 1)]
                    back = [(v, 0)] if side and v not in (s, t) else [(x, 1) for x in near[v]] if not side else []
                    for y in ahead:
                        if y not in seen and used[(v, side), y] < 1:
                            seen[y] = (v, side)
                            todo.append(y)
                    for y in back:
                        if y not in seen and used[y, (v, side)] > 0:
                            seen[y] = (v, side)
                            todo.append(y)
                if (t, 0) not in seen:
                    return flow + direct
                y = (t, 0)
                while seen[y] is not None:
                    x = seen[y]
                    if used[y, x] > 0:
                        used[y, x] -= 1
                    else:
                        used[x, y] += 1
                    y = x
                flow += 1

        return {"id": ids, "connectivity": [cut(*sorted(near[u])[:2]) if len(near[u]) > 1 else 0 for u in range(len(ids))]}

    return per_component(graph, solve, "id long, connectivity long")


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Numbers of links (i, j) of n nodes that are a spanning forest: in each round every part takes its first link to another part."""
    part, taken = np.arange(n), []
    left = np.flatnonzero(i != j)
    while len(left):
        first = np.full(n, len(i))
        for end in (i, j):
            np.minimum.at(first, part[end[left]], left)
        new = np.unique(first[first < len(i)])
        taken.append(new)
        node, low = least_linked(part[i[new]], part[j[new]])
        name = np.arange(n)
        name[node] = low
        part = name[part]
        left = left[part[i[left]] != part[j[left]]]
    return np.concatenate(taken) if taken else left


def _certified(links: DataFrame) -> DataFrame:
    """(a, b): of the links of a stretch of a task those of two spanning forests, the second of what the first leaves. Every cut of the stretch that has
    at most one link keeps it, and others keep two, so bridges stay what they are whatever other tasks hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held))
            names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            i, j = at[: len(a)], at[len(a) :]
            one = _forest(i, j, len(names))
            rest = np.setdiff1d(np.arange(len(a)), one)
            kept = np.concatenate([one, rest[_forest(i[rest], j[rest], len(names))]])
            return pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], ["a", "b"])

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n += len(batch)
            if n >= AT_ONCE:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def _bridges_at_once(links: DataFrame) -> DataFrame:
    """(a, b) of the bridges of few links, in one task: a link to a node below which no link leads back to where it began or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches]
        if not held:
            return
        a, b = (np.concatenate(x) for x in zip(*held))
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        near = [[] for _ in names]
        for k, (i, j) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist())):
            near[i].append((j, k))
            near[j].append((i, k))
        order, low, found = {}, {}, []
        for root in range(len(names)):
            if root in order:
                continue
            order[root] = low[root] = len(order)
            stack = [(root, -1, iter(near[root]))]
            while stack:
                v, via, rest = stack[-1]
                for x, k in rest:
                    if k == via:
                        continue
                    if x not in order:
                        order[x] = low[x] = len(order)
                        stack.append((x, k, iter(near[x])))
                        break
                    low[v] = min(low[v], order[x])
                else:
                    stack.pop()
                    if stack:
                        u = stack[-1][0]
                        low[u] = min(low[u], low[v])
                        if low[v] > order[u]:
                            found.append(via)
        yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(b[found])], ["a", "b"])

    return links.coalesce(1).mapInArrow(run, "a long, b long")


def _bridges_by_levels(links: DataFrame) -> DataFrame:
    """(a, b) of the bridges of any number of links: a breadth-first forest from the least node of each component, a join for a level; links outside of
    it are marked with two hashes of 64 bits at both ends, and a level at a time nodes pass the exclusive or of their marks up. What lies below a link
    of the forest has no link out of it if all its marks cancel."""
    both = settle(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    roots = _components(links, "a", "b").where("id = component").select("id")
    front = settle(roots.select("id", F.lit(None).cast("long").alias("up")), "front")
    levels, seen = [front], front
    while True:
        step = front.select(F.col("id").alias("a")).join(both, "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up"))
        front = settle(step.join(seen.select("id"), "id", "left_anti"), "front")
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.unionByName(front)
    tree = seen.where("up IS NOT NULL").select(F.least("id", "up").alias("a"), F.greatest("id", "up").alias("b"))
    outside = settle(links.join(tree, ["a", "b"], "left_anti"), "outside")
    marks = outside.select(F.explode(F.array("a", "b")).alias("id"), F.xxhash64("a", "b").alias("x"), F.xxhash64("b", F.lit(1), "a").alias("y"))
    marks, below, found = settle(marks.groupBy("id").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")), "marks"), None, None
    for level in reversed(levels[1:]):
        own = level.join(marks, "id", "left").select("id", "up", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
        if below is not None:
            own = own.unionByName(below.join(level.select("id"), "id", "left_semi").select("id", F.lit(None).cast("long").alias("up"), "x", "y"))
        own = settle(own.groupBy("id").agg(F.max("up").alias("up"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")), "level")
        free = own.where("x = 0 AND y = 0").select(F.least("id", "up").alias("a"), F.greatest("id", "up").alias("b"))
        found = free if found is None else found.unionByName(free)
        below = own.select(F.col("up").alias("id"), "x", "y")
    return found if found is not None else links.where("false")


def bridges(graph: DataFrame) -> DataFrame:
    """(src, dst) of pairs of weight 1 without which their ends are apart. Every task first keeps two forests of its links; up to LAST links that
    are left are finished by one task, and beyond that the forest is searched and summed a level at a time."""
    pairs = settle(neighbours(graph).where("src < dst").groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.sum("weight").alias("w")), "pairs")
    return pairs.where("w = 1").join(bridges_of(pairs), ["a", "b"], "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def bridges_of(links: DataFrame) -> DataFrame:
    """(a, b): the links without which their ends are apart; links are (a, b), a < b, each once."""
    few = settle(_certified(links), "forests")
    return _bridges_at_once(few) if few.count() <= LAST else _bridges_by_levels(few)


def hubs(dist: DataFrame, parts: DataFrame, share: float) -> DataFrame:
    """Nodes of the shortest mean path in each component: share of all nodes, rounded up, from each; components too small for three
    quarters of one are left out."""
    n = F.broadcast(parts.agg(F.count("*").alias("all")))
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    mean = dist.where("d > 0").groupBy(F.col("s").alias("id")).agg((F.sum(F.col("d") * _times(dist)) / F.sum(_times(dist))).alias("mean")).join(parts, "id").join(sizes, "component").crossJoin(n)
    mean = mean.where(F.col("size") * share >= 0.75).withColumn("r", F.row_number().over(Window.partitionBy("component").orderBy("mean", "id")))
    return mean.where(F.col("r") <= F.ceil(F.col("all") * share)).select("id", "component", "mean")


def distance_to(graph: DataFrame, roots: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, d): steps from each root to its nearest target other than itself; roots that reach none are left out."""
    dist = distances(graph, roots)
    near = dist.where("d > 0").join(targets.select(F.col("id").alias("t")).distinct(), "t", "left_semi")
    return near.groupBy(F.col("s").alias("id")).agg(F.min("d").alias("d"))


def identity_path_lengths(dist: DataFrame, identities: DataFrame) -> DataFrame:
    """(root, target, mean): the mean of the distance from nodes of one identity to the nearest other node of another."""
    each = identities.select("id", F.explode("ids").alias("identity"))
    near = dist.where("d > 0").join(each.select(F.col("id").alias("t"), F.col("identity").alias("target")), "t").groupBy("s", "target").agg(F.min("d").alias("d"))
    return near.join(each.select(F.col("id").alias("s"), F.col("identity").alias("root")), "s").groupBy("root", "target").agg(F.avg("d").alias("mean"))


def border_nodes(graph: DataFrame, communities: DataFrame) -> DataFrame:
    """(id, degree, links, communities): nodes with neighbours in other communities, how many such links and communities they have, and
    their degree in the graph of the border nodes."""
    a, b = communities.select(F.col("id").alias("a"), F.col("com").alias("ca")), communities.select(F.col("id").alias("b"), F.col("com").alias("cb"))
    links = simple(graph)
    across = links.join(a, "a").join(b, "b").where("ca <> cb")
    per = across.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("links"), F.countDistinct("cb").alias("communities"))
    ids = per.select("id")
    inner = links.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    return per.join(inner, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), "links", "communities")


def statistics(graph: DataFrame, dist: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """One row of numbers about a graph; diameter and mean path are null if it is not connected."""
    links = simple(graph)
    k = links.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("k"))
    ends = links.join(k.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    size = graph.agg(F.sum("weight").alias("edges"), F.count("*").alias("pairs"))
    per = vertices(graph).join(triangles(graph), "id").join(k, "id", "left").na.fill(0, ["k"])
    return statistics_of(degrees(graph), size, components(graph), per, ends.agg(F.corr("ka", "kb").alias("assortativity")), dist, all_nodes)


def statistics_of(d: DataFrame, size: DataFrame, parts: DataFrame, per: DataFrame, ends: DataFrame, dist: DataFrame, all_nodes: DataFrame | None) -> DataFrame:
    """The result of `statistics` from degrees (id, degree), a row (edges, pairs), components, (id, k, triangles) of each node, a row (assortativity), and
    distances."""
    v, pairs = per.select("id"), F.col("k") * (F.col("k") - 1)
    one = v.agg(F.count("*").alias("nodes"))
    for part in (
        size,
        parts.agg(F.countDistinct("component").alias("components")),
        parts.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest_component")),
        d.agg(F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree")),
        per.agg((F.sum("triangles") / 3).cast("long").alias("triangles"), F.avg(F.coalesce(F.try_divide(2 * F.col("triangles"), pairs), F.lit(0.0))).alias("mean_clustering"), F.sum(F.when(F.col("k") > 0, pairs / 2)).alias("wedges")),
        ends,
        dist.agg(F.max("d").alias("longest"), F.try_divide(F.sum(F.col("d") * _times(dist)), F.sum(F.when(F.col("d") > 0, _times(dist)))).alias("mean_path")),
        closeness(dist).agg(F.avg("closeness").alias("mean_closeness")),
        centrality_of(d).agg(F.avg("centrality").alias("mean_degree_centrality")),
    ):
        one = one.crossJoin(F.broadcast(part))
    alone = (all_nodes.select("id").join(v, "id", "left_anti").agg(F.count("*").alias("unconnected_nodes"))) if all_nodes is not None else v.where("false").agg(F.count("*").alias("unconnected_nodes"))
    whole = F.col("components") == 1
    return one.crossJoin(F.broadcast(alone)).select(
        "nodes", "edges", "pairs", F.try_divide(2 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"), whole.alias("connected"), "components", "largest_component", "mean_degree", "max_degree", "min_degree",
        "triangles", F.try_divide(3 * F.col("triangles"), "wedges").alias("transitivity"), "mean_clustering", "mean_degree_centrality", "mean_closeness", "assortativity",
        F.when(whole, F.col("longest")).alias("diameter"), F.when(whole, F.col("mean_path")).alias("mean_path"), (whole & (F.col("edges") == F.col("nodes") - 1)).alias("tree"), "unconnected_nodes",
    )
