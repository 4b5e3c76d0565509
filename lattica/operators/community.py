"""Communities: finding them and measuring a partition. Labels are 1..n by size; the same input gives the same labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..helpers import settle
from .edges import neighbours
from .graph import components, simple, vertices
from .identity import by_size


def label_propagation(graph: DataFrame, rounds: int = 30, weighted: bool = True, seed: int = 42) -> DataFrame:
    """(id, com): in each round half the nodes, picked by a hash of id and round, take the label that weighs most among their neighbours and
    themselves, ties to the smaller. Halves keep two neighbours from swapping labels for ever."""
    links = settle(neighbours(graph).where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("weight") if weighted else F.lit(1)).cast("double").alias("w")), "links")
    state, mark, quiet = settle(vertices(graph).select("id", F.col("id").alias("com")), "labels"), None, 0
    for turn in range(rounds):
        votes = links.join(state.select(F.col("id").alias("b"), "com"), "b").groupBy("a", "com").agg(F.sum("w").alias("w"))
        best = votes.groupBy(F.col("a").alias("id")).agg(F.min_by("com", F.struct((-F.col("w")).alias("k"), "com")).alias("new"))
        moves = F.pmod(F.xxhash64("id", F.lit(seed + turn)), F.lit(2)) == 0
        state = settle(state.join(best, "id", "left").select("id", F.when(moves, F.coalesce("new", "com")).otherwise(F.col("com")).alias("com")), "labels")
        now = state.agg(F.sum(F.xxhash64("id", "com").cast("decimal(38,0)"))).first()[0]
        quiet = quiet + 1 if now == mark else 0
        if quiet == 3:
            break
        mark = now
    return by_size(state)


def modularity(graph: DataFrame, communities: DataFrame) -> float:
    """Weighted modularity of a partition."""
    links = neighbours(graph).withColumn("w", F.when(F.col("src") == F.col("dst"), 2 * F.col("weight")).otherwise(F.col("weight")))
    a, b = communities.select(F.col("id").alias("src"), F.col("com").alias("ca")), communities.select(F.col("id").alias("dst"), F.col("com").alias("cb"))
    per = links.join(a, "src").join(b, "dst").groupBy(F.col("ca").alias("com")).agg(F.sum("w").alias("total"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0)).alias("inside"))
    all_w, inside, squares = per.agg(F.sum("total"), F.sum("inside"), F.sum(F.pow(F.col("total").cast("double"), F.lit(2.0)))).first()
    return float(inside / all_w - squares / all_w**2) if all_w else 0.0


def louvain(graph: DataFrame, weighted: bool = True, seed: int = 42, levels: int = 10, rounds: int = 12) -> DataFrame:
    """(id, com) by local moves and aggregation. A round lets half the nodes (by hash) move to the neighbouring community of the greatest gain
    in modularity, if there is one; rounds and levels end when modularity no longer rises. Moves of a round are judged on its beginning,
    so a round that lowers modularity is undone."""
    return _optimised(graph, weighted, seed, levels, rounds, False)


def leiden(graph: DataFrame, weighted: bool = True, seed: int = 42, levels: int = 10, rounds: int = 12) -> DataFrame:
    """(id, com) as louvain() finds them, with a refinement before each aggregation: every community is built up anew from single nodes, which
    join a piece of their own community that they are linked to where that raises modularity. Pieces are what is aggregated, and they begin
    the next level in the communities they come from; so a community can be parted again, and pieces are connected."""
    return _optimised(graph, weighted, seed, levels, rounds, True)


def _moved(now: DataFrame, links: DataFrame, state: DataFrame, total: float, seed: int, rounds: int) -> tuple[DataFrame, bool]:
    """state (id, k, com) after local moves, and whether there were any."""
    best, moved = modularity(now, state.select("id", "com")), False
    for turn in range(rounds):
        coms = state.groupBy("com").agg(F.sum("k").alias("total"))
        to = links.join(state.select(F.col("id").alias("dst"), "com"), "dst").groupBy(F.col("src").alias("id"), "com").agg(F.sum("w").alias("kin"))
        own = state.select("id", "k", F.col("com").alias("old"))
        stay = own.select("id", F.col("old").alias("com"), F.lit(0.0).alias("kin"))
        options = to.unionByName(stay).groupBy("id", "com").agg(F.sum("kin").alias("kin")).join(own, "id").join(coms, "com")
        rest = F.col("total") - F.when(F.col("com") == F.col("old"), F.col("k")).otherwise(0.0)
        score = F.round(F.col("kin") - F.col("k") * rest / total, 9)
        pick = options.withColumn("score", score).groupBy("id").agg(F.min_by("com", F.struct((-F.col("score")).alias("s"), F.when(F.col("com") == F.col("old"), 0).otherwise(1).alias("o"), "com")).alias("new"))
        moves = F.pmod(F.xxhash64("id", F.lit(seed + turn)), F.lit(2)) == 0
        next_state = settle(state.join(pick, "id").select("id", "k", F.when(moves, F.col("new")).otherwise(F.col("com")).alias("com")), "state")
        q = modularity(now, next_state.select("id", "com"))
        if q > best + 1e-9:
            state, best, moved = next_state, q, True
        elif turn > 2:
            break
    return state, moved


def _refined(links: DataFrame, state: DataFrame, total: float, seed: int, rounds: int) -> DataFrame:
    """(id, com, within): the communities `within` of state taken apart. In a round half the nodes that are still alone, by hash, join the piece of
    their community of the greatest gain among those that do not move in this round, so that a piece never loses what holds it together."""
    inner = settle(links.join(state.select(F.col("id").alias("src"), F.col("com").alias("a")), "src").join(state.select(F.col("id").alias("dst"), F.col("com").alias("b")), "dst").where("a = b").select("src", "dst", "w"), "inner")
    now = settle(state.select("id", "k", F.col("com").alias("within"), F.col("id").alias("com")), "pieces")
    quiet = 0
    for turn in range(rounds):
        pieces = now.groupBy("com").agg(F.count("*").alias("n"), F.sum("k").alias("total"))
        known = settle(now.join(pieces, "com").withColumn("free", (F.col("n") == 1) & (F.pmod(F.xxhash64("id", F.lit(seed + turn)), F.lit(2)) == 0)), "known")
        to = inner.join(known.where("NOT free").select(F.col("id").alias("dst"), "com", "total"), "dst").join(known.where("free").select(F.col("id").alias("src"), "k"), "src")
        options = to.groupBy(F.col("src").alias("id"), "com").agg(F.round(F.sum("w") - F.first("k") * F.first("total") / total, 9).alias("gain")).where("gain > 0")
        pick = settle(options.groupBy("id").agg(F.min_by("com", F.struct((-F.col("gain")).alias("g"), "com")).alias("new")), "picks")
        quiet = quiet + 1 if pick.isEmpty() else 0
        if quiet == 2:
            break
        now = settle(known.select("id", "k", "within", "com").join(pick, "id", "left").select("id", "k", "within", F.coalesce("new", "com").alias("com")), "pieces")
    return now.select("id", "com", "within")


def _optimised(graph: DataFrame, weighted: bool, seed: int, levels: int, rounds: int, refine: bool) -> DataFrame:
    now = settle(graph.select("src", "dst", (F.col("weight") if weighted else F.lit(1)).cast("double").alias("weight")), "level")
    total = 2 * (now.agg(F.sum("weight")).first()[0] or 0.0)
    names, begin = settle(vertices(graph).select("id", F.col("id").alias("node")), "names"), None
    out = names.select("id", F.col("node").alias("com"))
    if not total:
        return by_size(out)
    return levels_of(now, names, begin, out, total, seed, 0, levels, rounds, refine)


def levels_of(now: DataFrame, names: DataFrame, begin: DataFrame | None, out: DataFrame, total: float, seed: int, first: int, levels: int, rounds: int, refine: bool) -> DataFrame:
    """(id, com) after levels of local moves from the first on, on the graph now of nodes; names (id, node), begin (id, com) where nodes begin."""
    for level in range(first, levels):
        both = settle(neighbours(now).withColumn("w", F.when(F.col("src") == F.col("dst"), 2 * F.col("weight")).otherwise(F.col("weight"))).select("src", "dst", "w"), "both")
        strength = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
        state = settle(strength.join(begin, "id") if begin is not None else strength.select("id", "k", F.col("id").alias("com")), "state")
        links = both.where("src <> dst")
        state, moved = _moved(now, links, state, total, seed + 97 * level, rounds)
        out = settle(names.join(state.select(F.col("id").alias("node"), "com"), "node").select("id", "com"), "communities")
        if not moved:
            break
        pieces = settle(_refined(links, state, total, seed + 97 * level, rounds) if refine else state.select("id", "com", F.col("com").alias("within")), "groups")
        begin = settle(pieces.select(F.col("com").alias("id"), F.col("within").alias("com")).distinct(), "begin") if refine else None
        names = settle(names.join(pieces.select(F.col("id").alias("node"), "com"), "node").select("id", F.col("com").alias("node")), "names")
        a, b = pieces.select(F.col("id").alias("src"), F.col("com").alias("ca")), pieces.select(F.col("id").alias("dst"), F.col("com").alias("cb"))
        merged = now.join(a, "src").join(b, "dst").groupBy(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst")).agg(F.sum("weight").alias("weight"))
        now = settle(merged, "level")
    return by_size(out)


def partition_statistics(graph: DataFrame, communities: DataFrame) -> DataFrame:
    """(com, size, inside, cut, density, conductance, mixing) for each community: pairs and weights within it and across its border, density of
    its pairs, border weight over the smaller side's strength, and the share of its strength that crosses."""
    both = neighbours(graph).where("src <> dst")
    a, b = communities.select(F.col("id").alias("src"), F.col("com").alias("ca")), communities.select(F.col("id").alias("dst"), F.col("com").alias("cb"))
    return partition_of(both.join(a, "src").join(b, "dst").groupBy("ca", "cb").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")), communities)


def partition_of(rows: DataFrame, communities: DataFrame) -> DataFrame:
    """The result of `partition_statistics` from (ca, cb, weight, n), weights and pairs between communities counted from both ends."""
    same = F.col("ca") == F.col("cb")
    per = rows.groupBy(F.col("ca").alias("com")).agg(
        (F.sum(F.when(same, F.col("weight")).otherwise(0)) / 2).cast("long").alias("inside"), F.sum(F.when(~same, F.col("weight")).otherwise(0)).cast("long").alias("cut"),
        F.sum("weight").alias("strength"), (F.sum(F.when(same, F.col("n")).otherwise(0)) / 2).alias("pairs"),
    )
    sizes = communities.groupBy("com").agg(F.count("*").alias("size"))
    whole = F.broadcast(rows.agg(F.sum("weight").alias("all")))
    out = sizes.join(per, "com", "left").na.fill(0).crossJoin(whole)
    return out.select(
        "com", "size", "inside", "cut", F.coalesce(F.try_divide(2 * F.col("pairs"), F.col("size") * (F.col("size") - 1)), F.lit(0.0)).alias("density"),
        F.coalesce(F.try_divide(F.col("cut"), F.least("strength", F.col("all") - F.col("strength"))), F.lit(0.0)).alias("conductance"),
        F.coalesce(F.try_divide(F.col("strength") - 2 * F.col("inside"), "strength"), F.lit(0.0)).alias("mixing"),
    )


def community_internals(graph: DataFrame, communities: DataFrame) -> DataFrame:
    """(com, size, clustering, centrality, connected, path) of the subgraph that each community induces, weights aside: mean clustering coefficient
    and degree centrality of its nodes (1 for a single node), whether it is connected, and the mean distance over its pairs if it is (0 for a
    single node). Nodes of the graph without a community are left out; those of a community without links count.

    Without the links between communities the induced subgraphs are parts of one graph, so a level of their searches is one join for all of them
    and no pair crosses; rows are the pairs that reach each other inside a community."""
    from .graph import clustering, distances

    own = communities.select("id", "com").distinct()
    a, b = own.select(F.col("id").alias("src"), F.col("com").alias("ca")), own.select(F.col("id").alias("dst"), F.col("com").alias("cb"))
    inner = settle(graph.where("src <> dst").join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", "weight"), "inner")
    k = neighbours(inner).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("k"))
    reached = distances(inner).where("d > 0").groupBy(F.col("s").alias("id")).agg(F.count("*").alias("reached"), F.sum("d").alias("total"))
    return internals_of(own.join(k, "id", "left").join(clustering(inner), "id", "left").join(reached, "id", "left").na.fill(0))


def internals_of(nodes: DataFrame) -> DataFrame:
    """The result of `community_internals` from (id, com, k, clustering, reached, total)."""
    per = nodes.groupBy("com").agg(F.count("*").alias("size"), F.avg("clustering").alias("clustering"), F.sum("k").alias("k"), F.sum("reached").alias("pairs"), F.sum("total").alias("total"))
    all_pairs = F.col("size") * (F.col("size") - 1)
    connected = F.col("pairs") == all_pairs
    return per.select(
        "com", "size", "clustering", F.coalesce(F.try_divide("k", all_pairs), F.lit(1.0)).alias("centrality"), connected.alias("connected"),
        F.when(connected, F.coalesce(F.try_divide("total", all_pairs), F.lit(0.0))).alias("path"),
    )


def community_links(graph: DataFrame, communities: DataFrame) -> DataFrame:
    """(com_a, com_b, pairs) for communities with links between them."""
    a, b = communities.select(F.col("id").alias("src"), F.col("com").alias("ca")), communities.select(F.col("id").alias("dst"), F.col("com").alias("cb"))
    rows = graph.join(a, "src").join(b, "dst").where("ca <> cb")
    return rows.groupBy(F.least("ca", "cb").alias("com_a"), F.greatest("ca", "cb").alias("com_b")).agg(F.count("*").alias("pairs"))


def communities_of_degree(graph: DataFrame, communities: DataFrame, bound: float) -> DataFrame:
    """(com, mean): communities whose nodes have a mean number of neighbours above the bound."""
    return communities_of(simple(graph).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("k")), communities, bound)


def communities_of(k: DataFrame, communities: DataFrame, bound: float) -> DataFrame:
    """The result of `communities_of_degree` from (id, k)."""
    return communities.join(k, "id").groupBy("com").agg(F.avg("k").alias("mean")).where(F.col("mean") > bound)


def supercommunities(communities: DataFrame, groups: DataFrame, least: int = 0) -> DataFrame:
    """(id, com): nodes of communities put together by a table (com, group) and renumbered by size; communities below `least` nodes get 0."""
    sizes = communities.groupBy("com").agg(F.count("*").alias("size"))
    rows = communities.join(sizes, "com").join(groups, "com", "left")
    out = rows.where((F.col("size") < least) | F.col("group").isNull()).select("id", F.lit(0).cast("long").alias("com"))
    return by_size(rows.where((F.col("size") >= least) & F.col("group").isNotNull()).select("id", F.col("group").cast("long").alias("com"))).unionByName(out)


def branch_repair(graph: DataFrame, free: DataFrame | None = None, most_free: float = 0.4) -> DataFrame:
    """(id, to): labels that do not touch the largest label are joined with those they touch, by their smallest label; labels whose share of
    free surface in `free` (id, share) is most_free or more keep their own."""
    top = F.broadcast(graph.agg(F.max(F.greatest("src", "dst")).alias("top")))
    links = simple(graph)
    safe = links.crossJoin(top).where("a = top").select(F.col("b").alias("id")).union(top.select(F.col("top").alias("id"))).distinct()
    rest = vertices(graph).join(safe, "id", "left_anti")
    if free is not None:
        rest = rest.join(free.where(F.col("share") >= most_free).select("id"), "id", "left_anti")
    inner = graph.join(rest.withColumnRenamed("id", "src"), "src", "left_semi").join(rest.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return components(inner).select("id", F.col("component").alias("to"))
