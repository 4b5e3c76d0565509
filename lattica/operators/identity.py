"""Identities of nodes (several to a node) and how communities and neighbourhoods are made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edges import neighbours
from .ranks import numbered


def parse(column: str | Column) -> Column:
    """An identity cell as an array: JSON or Python lists are read, anything else is one identity; null and blank are none."""
    c = F.col(column) if isinstance(column, str) else column
    inner = F.regexp_extract(c, r"^\s*\[(.*)\]\s*$", 1)
    items = F.filter(F.transform(F.split(inner, r"\s*,\s*"), lambda s: F.regexp_replace(F.trim(s), r"""^['"]|['"]$""", "")), lambda s: s != "")
    none = F.array().cast("array<string>")
    return F.when(c.isNull() | (F.trim(c) == ""), none).when(c.rlike(r"^\s*\["), items).otherwise(F.array(c))


def domain(identities: DataFrame, combinations: bool = False) -> DataFrame:
    """Every identity once; with combinations also each different list of more than one, as JSON."""
    single = identities.select(F.explode("ids").alias("identity"))
    if combinations:
        single = single.unionByName(identities.where(F.size("ids") > 1).select(F.to_json("ids").alias("identity")))
    return single.distinct()


def select(identities: DataFrame, *wanted: str) -> DataFrame:
    """Nodes that have the one identity asked for, or whose list equals the several asked for."""
    if len(wanted) == 1:
        return identities.where(F.array_contains("ids", wanted[0]))
    return identities.where(F.col("ids") == F.array(*map(F.lit, wanted)))


def gate(identities: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """Nodes that have all of the positive and none of the negative identities."""
    ok = F.lit(True)
    for p in positive:
        ok = ok & F.array_contains("ids", p)
    for n in negative:
        ok = ok & ~F.array_contains("ids", n)
    return identities.where(ok)


def without_negatives(identities: DataFrame) -> DataFrame:
    """Identities that end in - are taken out; a node without others keeps an empty list."""
    return identities.withColumn("ids", F.filter("ids", lambda i: ~F.endswith(i, F.lit("-"))))


def one_each(identities: DataFrame, seed: int = 42) -> DataFrame:
    """One identity for each node, picked by a hash of its id and the seed."""
    return identities.where(F.size("ids") > 0).select("id", F.array(F.element_at("ids", (F.pmod(F.xxhash64("id", F.lit(seed)), F.size("ids").cast("long")) + 1).cast("int"))).alias("ids"))


def inverted(identities: DataFrame) -> DataFrame:
    """(identity, nodes): the inverted index; lists are sorted."""
    return identities.select("id", F.explode("ids").alias("identity")).groupBy("identity").agg(F.array_sort(F.collect_list("id")).alias("nodes"))


def composition(communities: DataFrame, identities: DataFrame) -> DataFrame:
    """(com, identity, n, size, share): how many of a community's nodes have an identity, over all its nodes, those without any included."""
    sizes = communities.groupBy("com").agg(F.count("*").alias("size"))
    counts = communities.join(identities, "id").select("com", F.explode("ids").alias("identity")).groupBy("com", "identity").agg(F.count("*").alias("n"))
    names = identities.select(F.explode("ids").alias("identity")).distinct()
    # the table asked for has a cell for each community and identity
    grid = sizes.crossJoin(F.broadcast(names))
    return grid.join(counts, ["com", "identity"], "left").select("com", "identity", F.coalesce("n", F.lit(0)).alias("n"), "size", (F.coalesce("n", F.lit(0)) / F.col("size")).alias("share"))


def shares_of_identity(communities: DataFrame, identities: DataFrame) -> DataFrame:
    """(com, identity, share, over): the part of an identity's nodes that a community has, and that part over the community's part of all."""
    per = composition(communities, identities)
    total = per.groupBy("identity").agg(F.sum("n").alias("all"))
    nodes = communities.agg(F.count("*").alias("nodes"))
    rows = per.join(total, "identity").crossJoin(F.broadcast(nodes)).withColumn("share", F.try_divide("n", "all"))
    return rows.select("com", "identity", "share", F.try_divide(F.col("share"), F.col("size") / F.col("nodes")).alias("over"))


def weighted_composition(communities: DataFrame, identities: DataFrame) -> DataFrame:
    """(identity, share): counts weighted by community size, made to sum to one."""
    per = composition(communities, identities).groupBy("identity").agg(F.sum(F.col("n") * F.col("size")).alias("w"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("w").alias("all")))).select("identity", F.try_divide("w", "all").alias("share"))


def density_heat(communities: DataFrame) -> DataFrame:
    """(com, heat): logarithm of a community's size over the mean size."""
    sizes = communities.groupBy("com").agg(F.count("*").alias("size"))
    return sizes.crossJoin(F.broadcast(sizes.agg(F.avg("size").alias("mean")))).select("com", F.log(F.col("size") / F.col("mean")).alias("heat"))


def by_size(communities: DataFrame) -> DataFrame:
    """Communities renumbered from 1 by size, the largest first, ties by their old number."""
    sizes = communities.groupBy("com").agg(F.count("*").alias("size"))
    rank = numbered(sizes, F.desc("size"), "com", start=1, name="rank").select("com", F.col("rank").cast("long").alias("rank"))
    return communities.join(rank, "com").select("id", F.col("rank").alias("com"))


def neighbour_identities(graph: DataFrame, identities: DataFrame, root: str) -> DataFrame:
    """(identity, n, share): identities of the nodes that have a neighbour with the root identity, each node once, and n over the
    nodes that have that identity at all."""
    roots = identities.where(F.array_contains("ids", root)).select(F.col("id").alias("src"))
    touched = neighbours(graph).join(roots, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    every = identities.select("id", F.explode("ids").alias("identity"))
    total = every.groupBy("identity").agg(F.count("*").alias("all"))
    n = every.join(touched, "id", "left_semi").groupBy("identity").agg(F.count("*").alias("n"))
    return total.join(n, "identity", "left").select("identity", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("all")).alias("share"))


def neighbour_vectors(graph: DataFrame, identities: DataFrame) -> DataFrame:
    """(id, identity, share): what a node's neighbours are, each neighbour's identities counted once; rows sum to one. Zero rows are left out."""
    rows = neighbours(graph).where("src <> dst").join(identities.select(F.col("id").alias("dst"), F.explode("ids").alias("identity")), "dst")
    per = rows.groupBy(F.col("src").alias("id"), "identity").agg(F.count("*").alias("n"))
    total = per.groupBy("id").agg(F.sum("n").alias("all"))
    return per.join(total, "id").select("id", "identity", (F.col("n") / F.col("all")).alias("share"))


def heat_matrix(cells: DataFrame, row: str, column: str, value: str, zero_last: bool = True) -> DataFrame:
    """The matrix of (row, column, value) with a column for each value of `column`, sorted; row 0 comes last, by the column `at`."""
    names = [r[0] for r in cells.select(column).distinct().orderBy(column).collect()]  # these become the columns of the result
    wide = cells.groupBy(row).pivot(column, names).agg(F.first(value)).na.fill(0.0)
    return wide.withColumn("at", F.when(F.col(row) == 0, F.lit(2**62)).otherwise(F.col(row)) if zero_last else F.col(row))


def classify(column: Column, rules: list[tuple[str, list[str], list[str]]], hierarchical: bool = True) -> Column:
    """The identity lists that ordered rules (name, all of, none of) give a string: of the first that holds, or of all that do. A rule without
    conditions holds for everything; null where none holds."""
    holds = lambda pos, neg: _all([F.contains(column, F.lit(p)) for p in pos] + [~F.contains(column, F.lit(n)) for n in neg])
    if hierarchical:
        out = F.lit(None).cast("array<string>")
        for name, pos, neg in reversed(rules):
            out = F.when(holds(pos, neg), F.array(F.lit(name))).otherwise(out)
        return out
    found = F.array_compact(F.array(*[F.when(holds(pos, neg), F.lit(name)) for name, pos, neg in rules]))
    return F.when(F.size(found) > 0, found)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def remap(identities: DataFrame, mapping: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Identities renamed by a table (identity, to); with keep, others than these (after renaming) are taken out, and nodes left without."""
    rows = identities.select("id", F.posexplode("ids").alias("at", "identity")).join(mapping, "identity", "left").withColumn("now", F.coalesce("to", "identity"))
    rows = rows.where(F.col("now").isin(keep)) if keep is not None else rows
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "now"))), lambda s: s["now"]).alias("ids"))
