"""Edge lists and graphs: building them from co-occurrence, collapsing, filtering and rewriting them.

An edge list is a multiset of (node_a, node_b, edge_c) rows; a graph has a row (src, dst, weight) for each unordered pair, src <= dst.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of draws that are counted to find the last draw of a random graph.
STRETCHES = 4096


def co_occurrence(occurrences: DataFrame) -> DataFrame:
    """Edges between nodes that the same connecting object touches, one for each object and pair. Objects that touch one node are dropped
    before the self-join, so that only those that make pairs are shuffled twice."""
    seen = occurrences.where("edge <> 0 AND node <> 0").select("edge", "node").distinct()
    a, b = seen.select(F.col("edge").alias("edge_c"), F.col("node").alias("node_a")), seen.select(F.col("edge").alias("edge_c"), F.col("node").alias("node_b"))
    return a.join(b, "edge_c").where("node_a < node_b").select("node_a", "node_b", "edge_c")


def collapse(edges: DataFrame) -> DataFrame:
    """The weighted graph: how many rows each unordered pair has."""
    return edges.groupBy(F.least("node_a", "node_b").alias("src"), F.greatest("node_a", "node_b").alias("dst")).agg(F.count("*").alias("weight"))


def neighbours(graph: DataFrame) -> DataFrame:
    """Both directions of the graph's pairs; a self-loop once."""
    back = graph.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return graph.select("src", "dst", "weight").unionByName(back)


def without_duplicates(edges: DataFrame, order: str = "edge_c") -> DataFrame:
    """One row for each unordered pair: the first in the given order, with its own direction and edge_c."""
    first = F.min_by(F.struct("node_a", "node_b", "edge_c"), F.struct(order, "node_a", "node_b", "edge_c")).alias("e")
    return edges.groupBy(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v")).agg(first).select("e.*")


def degrees(graph: DataFrame, weighted: bool = True) -> DataFrame:
    """(id, degree): the sum of weights, or the number of neighbours; a self-loop counts twice."""
    value = F.col("weight") if weighted else F.lit(1)
    return graph.select(F.explode(F.array("src", "dst")).alias("id"), value.alias("w")).groupBy("id").agg(F.sum("w").cast("long").alias("degree"))


def degree_distribution(graph: DataFrame) -> DataFrame:
    """(k, p): the share of nodes with k neighbours, k from 1 to the greatest, zeros included."""
    return distribution(degrees(graph, weighted=False))


def distribution(d: DataFrame) -> DataFrame:
    """The result of `degree_distribution` from degrees (id, degree)."""
    per = d.groupBy(F.col("degree").alias("k")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("all"), F.max("k").alias("most"))
    ks = total.select("all", F.explode(F.sequence(F.lit(1).cast("long"), "most")).alias("k"))
    return ks.join(per, "k", "left").select("k", (F.coalesce("n", F.lit(0)) / F.col("all")).alias("p"))


def degree_heat(graph: DataFrame) -> DataFrame:
    """(id, heat): logarithm of a node's degree over the mean degree."""
    d = degrees(graph)
    return d.crossJoin(F.broadcast(d.agg(F.avg("degree").alias("mean")))).select("id", F.log(F.col("degree") / F.col("mean")).alias("heat"))


def top_by_degree(graph: DataFrame, share: float) -> DataFrame:
    """The share of nodes with the greatest degrees, at least one; ties by id. Nodes are counted by degree first, and the few whose degree
    is at the cut are ranked."""
    d = degrees(graph)
    quota = F.greatest(F.lit(1), F.floor(F.col("all") * share).cast("long"))
    per = d.groupBy("degree").agg(F.count("*").alias("n"))
    whole = per.agg(F.sum("n").alias("all"))
    above = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)
    cut = per.crossJoin(F.broadcast(whole)).select("degree", (quota - F.coalesce(F.sum("n").over(above), F.lit(0))).alias("room")).where("room > 0")
    ranked = d.join(F.broadcast(cut), "degree").withColumn("r", F.row_number().over(Window.partitionBy("degree").orderBy("id")))
    return ranked.where("r <= room").select("id", "degree")


def trim_to(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of which at least one end is among ids."""
    a, b = ids.select(F.col("id").alias("node_a"), F.lit(True).alias("ha")), ids.select(F.col("id").alias("node_b"), F.lit(True).alias("hb"))
    return edges.join(a.distinct(), "node_a", "left").join(b.distinct(), "node_b", "left").where("ha OR hb").select("node_a", "node_b", "edge_c")


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of which both ends are among ids."""
    keep = ids.select("id").distinct()
    return edges.join(keep.withColumnRenamed("id", "node_a"), "node_a", "left_semi").join(keep.withColumnRenamed("id", "node_b"), "node_b", "left_semi").select("node_a", "node_b", "edge_c")


def purge(edges: DataFrame, nodes: DataFrame, *attributes: DataFrame) -> list[DataFrame]:
    """Edges and attribute rows (by id) whose nodes are in the node image."""
    ids = nodes.select(F.col("label").alias("id")).distinct()
    return [subgraph(edges, ids), *(a.join(ids, "id", "left_semi") for a in attributes)]


def with_identities(edges: DataFrame, identities: DataFrame) -> DataFrame:
    """Edges with the identities of both ends, empty where a node has none."""
    none = F.array().cast("array<string>")
    a, b = identities.select(F.col("id").alias("node_a"), F.col("ids").alias("ids_a")), identities.select(F.col("id").alias("node_b"), F.col("ids").alias("ids_b"))
    rows = edges.join(a, "node_a", "left").join(b, "node_b", "left")
    return rows.select("node_a", "node_b", "edge_c", F.coalesce("ids_a", none).alias("ids_a"), F.coalesce("ids_b", none).alias("ids_b"))


def prune_same(edges: DataFrame, identities: DataFrame, target: str | None = None) -> DataFrame:
    """Without edges whose ends share an identity, or, with a target, whose ends both have it."""
    rows = with_identities(edges, identities)
    same = F.arrays_overlap("ids_a", "ids_b") if target is None else F.array_contains("ids_a", target) & F.array_contains("ids_b", target)
    return rows.where(~F.coalesce(same, F.lit(False))).select("node_a", "node_b", "edge_c")


def between(edges: DataFrame, identities: DataFrame, one: str, other: str) -> DataFrame:
    """Edges whose ends each have one of two identities."""
    either = F.array(F.lit(one), F.lit(other))
    return with_identities(edges, identities).where(F.arrays_overlap("ids_a", either) & F.arrays_overlap("ids_b", either)).select("node_a", "node_b", "edge_c")


def neighbours_of(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes with a neighbour among ids."""
    return neighbours(graph).join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def from_graph(graph: DataFrame) -> DataFrame:
    """The edge list of a graph: a row for each unit of weight, without connecting objects."""
    return graph.select(F.col("src").alias("node_a"), F.col("dst").alias("node_b"), F.explode(F.sequence(F.lit(1).cast("long"), "weight")).alias("i")).select("node_a", "node_b", F.lit(0).cast("long").alias("edge_c"))


def edges_to_nodes(edges: DataFrame, identities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Connecting objects become nodes, numbered above the greatest node: (a, c) and (c, b) for each row. Also the identities, `Node` where a
    node had none and `Edge` for the new ones."""
    top = F.broadcast(edges.agg(F.greatest(F.max("node_a"), F.max("node_b")).alias("top")))
    rows = edges.crossJoin(top).withColumn("c", F.col("edge_c") + F.col("top"))
    zero = F.lit(0).cast("long").alias("edge_c")
    out = rows.select("node_a", F.col("c").alias("node_b"), zero).unionByName(rows.select(F.col("c").alias("node_a"), "node_b", zero))
    ids = edges.select(F.explode(F.array("node_a", "node_b")).alias("id")).distinct()
    ids = ids.join(identities, "id", "left").select("id", F.coalesce("ids", F.array(F.lit("Node"))).alias("ids")) if identities is not None else ids.select("id", F.array(F.lit("Node")).alias("ids"))
    return out, ids.unionByName(rows.select(F.col("c").alias("id")).distinct().select("id", F.array(F.lit("Edge")).alias("ids")))


def communities_to_nodes(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Ends replaced by their communities, without rows inside one; communities are shifted by one if there is a community 0."""
    shift = F.broadcast(communities.agg(F.when(F.min("com") == 0, 1).otherwise(0).alias("shift")))
    a, b = communities.select(F.col("id").alias("node_a"), F.col("com").alias("ca")), communities.select(F.col("id").alias("node_b"), F.col("com").alias("cb"))
    rows = edges.join(a, "node_a").join(b, "node_b").where("ca <> cb").crossJoin(shift)
    return rows.select((F.col("ca") + F.col("shift")).alias("node_a"), (F.col("cb") + F.col("shift")).alias("node_b"), "edge_c")


def trunk(edges: DataFrame) -> DataFrame:
    """One row: the connecting object that most edges have, 0 excepted; the smallest of equals."""
    return edges.where("edge_c <> 0").groupBy("edge_c").agg(F.count("*").alias("n")).agg(F.min_by("edge_c", F.struct((-F.col("n")).alias("k"), "edge_c")).alias("trunk"))


def without_trunk(edges: DataFrame) -> DataFrame:
    return edges.join(F.broadcast(trunk(edges)), F.col("edge_c") == F.col("trunk"), "left_anti")


def trunk_to_node(edges: DataFrame) -> DataFrame:
    """The edges of the trunk run through a new node, numbered behind the greatest."""
    facts = F.broadcast(trunk(edges).crossJoin(edges.agg((F.greatest(F.max("node_a"), F.max("node_b")) + 1).alias("new"))))
    rows = edges.crossJoin(facts)
    zero = F.lit(0).cast("long")
    through = F.array(F.struct(F.col("node_a").alias("node_a"), F.col("new").alias("node_b"), zero.alias("edge_c")), F.struct(F.col("new").alias("node_a"), F.col("node_b").alias("node_b"), zero.alias("edge_c")))
    own = F.array(F.struct("node_a", "node_b", "edge_c"))
    return rows.select(F.explode(F.when(F.col("edge_c") == F.col("trunk"), through).otherwise(own)).alias("e")).select("e.*")


def add_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return edges.unionByName(pairs.select("node_a", "node_b", F.coalesce("edge_c", F.lit(0)).cast("long").alias("edge_c")) if "edge_c" in pairs.columns else pairs.select("node_a", "node_b", F.lit(0).cast("long").alias("edge_c")))


def remove_pairs(edges: DataFrame, pairs: DataFrame, by_object: bool = False) -> DataFrame:
    """Without the rows of the given pairs, whichever way round; with by_object only those with the same connecting object."""
    key = lambda df: [F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v")]
    on = ["u", "v"] + ["edge_c"] * by_object
    gone = pairs.select(*key(pairs), *["edge_c"] * by_object)
    return edges.select("*", *key(edges)).join(gone, on, "left_anti").select("node_a", "node_b", "edge_c")


def merge_labels(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ends renamed by a table (id, to); rows that become self-loops go."""
    a, b = mapping.select(F.col("id").alias("node_a"), F.col("to").alias("ta")), mapping.select(F.col("id").alias("node_b"), F.col("to").alias("tb"))
    rows = edges.join(a, "node_a", "left").join(b, "node_b", "left")
    return rows.select(F.coalesce("ta", "node_a").alias("node_a"), F.coalesce("tb", "node_b").alias("node_b"), "edge_c").where("node_a <> node_b")


def normalised_weights(graph: DataFrame) -> DataFrame:
    """Weights mapped to 0.1 .. 1 between the least and the greatest; all 0.1 if the greatest is 1."""
    facts = F.broadcast(graph.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi")))
    spread = 0.1 + 0.9 * F.try_divide(F.col("weight") - F.col("lo"), F.col("hi") - F.col("lo"))
    return graph.crossJoin(facts).select("src", "dst", F.when(F.col("hi") == 1, 0.1).otherwise(F.coalesce(spread, F.lit(1.0))).alias("weight"))


def random_equivalent(edges: DataFrame, seed: int = 42, simple: bool = False) -> DataFrame:
    """As many edges as there are between the same nodes, both ends drawn evenly and never the same. With simple no pair twice: draws are
    repeated up to ten times, so a nearly complete graph may come out with fewer."""
    return random_pairs(edges.select(F.explode(F.array("node_a", "node_b")).alias("id")).distinct(), edges.count(), seed, simple)


def random_pairs(nodes: DataFrame, m: int, seed: int = 42, simple: bool = False) -> DataFrame:
    """m edges of `random_equivalent` between nodes (id). With simple the first m different pairs count; as many draws are made as should hold them, and
    more if they do not, and a count of draws by stretches finds the last one, so that nothing is sorted as a whole."""
    from ..helpers import settle
    from .ranks import numbered

    spark, nodes = nodes.sparkSession, settle(numbered(nodes, "id"), "nodes")
    n = nodes.count()

    def drawn(k: int) -> DataFrame:
        draws = spark.range(k).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("i"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(max(n - 1, 1))).alias("j"))
        return draws.withColumn("j", F.when(F.col("j") >= F.col("i"), F.col("j") + 1).otherwise(F.col("j"))).where(F.lit(n) > 1)

    if not simple:
        pairs = drawn(m)
    else:
        full, k = n * (n - 1) / 2, 10 * m
        if 0 < m < full:
            k = min(k, int(-full * math.log1p(-m / full) * 1.01) + 1000)
        while True:
            # numbers of nodes are in the order of their ids
            pairs = settle(drawn(k).groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min("id").alias("id")), "draws")
            found = pairs.count()
            if found >= m or k == 10 * m:
                break
            k = min(2 * k, 10 * m)
        if found > m:
            stretch, left = k // STRETCHES + 1, m
            for row in pairs.groupBy(F.floor(F.col("id") / stretch).alias("at")).count().orderBy("at").collect():  # STRETCHES rows at most
                if row["count"] >= left:
                    break
                left -= row["count"]
            last = pairs.where(F.floor(F.col("id") / stretch) == row["at"]).orderBy("id").limit(left).agg(F.max("id")).first()[0]
            pairs = pairs.where(F.col("id") <= last)
    pairs = pairs.join(nodes.select(F.col("number").alias("i"), F.col("id").alias("node_a")), "i").join(nodes.select(F.col("number").alias("j"), F.col("id").alias("node_b")), "j")
    return pairs.select("node_a", "node_b", F.lit(0).cast("long").alias("edge_c"))
