"""Registered queries on identities and communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import inputs as I
from ..inputs import sql, table
from ..operators import edges as E
from ..operators import identity as D
from ..registry import query

_EACH = "each AS (SELECT id, unnest(ids) AS identity FROM idents)"
_COMP = f"{_EACH}, names AS (SELECT DISTINCT identity FROM each), sizes AS (SELECT com, count(*) AS size FROM coms GROUP BY 1), cnt AS (SELECT com, identity, count(*) AS n FROM coms JOIN each USING (id) GROUP BY 1, 2), comp AS (SELECT com, identity, coalesce(n, 0) AS n, size, coalesce(n, 0) / size AS share FROM sizes CROSS JOIN names LEFT JOIN cnt USING (com, identity))"


@query("S4_parse_identities", "SELECT s_suppkey AS k, array_to_string(ids, '|') AS ids, len(ids) AS n FROM (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN [s_name] WHEN 1 THEN [s_name, 'N' || s_nationkey] WHEN 2 THEN [s_name || ' x', 'c'] WHEN 5 THEN [s_name] ELSE [] END AS ids FROM supplier)")
def s4(spark, sf):
    name, k = F.col("s_name"), F.col("s_suppkey") % 6
    cell = F.when(k == 0, name).when(k == 1, F.concat(F.lit("['"), name, F.lit("', 'N"), F.col("s_nationkey").cast("string"), F.lit("']"))).when(k == 2, F.concat(F.lit('["'), name, F.lit(' x","c"]')))
    rows = I.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), cell.when(k == 3, "[]").when(k == 5, F.concat(F.lit("["), name, F.lit("]"))).alias("v"))
    return rows.select("k", D.parse("v").alias("ids")).select("k", F.array_join("ids", "|").alias("ids"), F.size("ids").cast("long").alias("n"))


@query("F17_has_identity", sql("SELECT id FROM idents WHERE list_contains(ids, 'credit')", "idents"))
def f17(spark, sf):
    return D.select(I.identities(spark, sf), "credit").select("id")


@query("F17_equals_identities", sql("SELECT id FROM idents WHERE ids = ['ASIA', 'credit']", "idents"))
def f17e(spark, sf):
    return D.select(I.identities(spark, sf), "ASIA", "credit").select("id")


@query("F18_gate", sql("SELECT id FROM idents WHERE list_contains(ids, 'credit') AND NOT list_contains(ids, 'ASIA')", "idents"))
def f18(spark, sf):
    return D.gate(I.identities(spark, sf), ["credit"], ["ASIA"]).select("id")


@query("F19_without_negatives", "SELECT p_partkey AS id, array_to_string(list_filter([p_brand || '+', CASE WHEN p_size > 20 THEN 'big+' ELSE 'big-' END], lambda x: x NOT LIKE '%-'), ',') AS ids FROM part")
def f19(spark, sf):
    p = table(spark, sf, "part")
    ids = p.select(F.col("p_partkey").alias("id"), F.array(F.concat("p_brand", F.lit("+")), F.when(F.col("p_size") > 20, "big+").otherwise("big-")).alias("ids"))
    return D.without_negatives(ids).select("id", F.array_join("ids", ",").alias("ids"))


@query("F20_one_each")
def f20(spark, sf):
    return D.one_each(I.identities(spark, sf)).select("id", F.array_join("ids", ",").alias("ids"))


@query("A24_inverted", sql(f"AND {_EACH} SELECT identity, array_to_string(list_sort(list(id)), ',') AS nodes FROM each GROUP BY 1", "idents"))
def a24(spark, sf):
    return D.inverted(I.identities(spark, sf)).select("identity", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


@query("A25_domain", sql("SELECT DISTINCT unnest(ids) AS identity FROM idents UNION SELECT DISTINCT '[\"' || array_to_string(ids, '\",\"') || '\"]' FROM idents WHERE len(ids) > 1", "idents"))
def a25(spark, sf):
    return D.domain(I.identities(spark, sf), combinations=True)


@query("A14_composition", sql(f"AND {_COMP} SELECT com, identity, n, size, round(share, 9) AS share FROM comp", "idents", "coms"))
def a14(spark, sf):
    return D.composition(I.communities(spark, sf), I.identities(spark, sf)).withColumn("share", F.round("share", 9))


@query("A15_shares", sql(f"AND {_COMP}, tot AS (SELECT identity, sum(n) AS t FROM comp GROUP BY 1) SELECT com, identity, round(n / nullif(t, 0), 9) AS share, round(n / nullif(t, 0) / (size / (SELECT count(*) FROM coms)), 9) AS over FROM comp JOIN tot USING (identity)", "idents", "coms"))
def a15(spark, sf):
    return D.shares_of_identity(I.communities(spark, sf), I.identities(spark, sf)).select("com", "identity", F.round("share", 9).alias("share"), F.round("over", 9).alias("over"))


@query("A16_weighted_composition", sql(f"AND {_COMP}, w AS (SELECT identity, sum(n * size) AS w FROM comp GROUP BY 1) SELECT identity, round(w / (SELECT sum(w) FROM w), 9) AS share FROM w", "idents", "coms"))
def a16(spark, sf):
    return D.weighted_composition(I.communities(spark, sf), I.identities(spark, sf)).select("identity", F.round("share", 9).alias("share"))


@query("A13_by_size", sql("AND r AS (SELECT com, row_number() OVER (ORDER BY count(*) DESC, com) AS rank FROM coms GROUP BY com) SELECT id, rank AS com FROM coms JOIN r USING (com)", "coms"))
def a13(spark, sf):
    return D.by_size(I.communities(spark, sf))


@query("A17_density_heat", sql("AND s AS (SELECT com, count(*) AS size FROM coms GROUP BY 1) SELECT com, round(ln(size / (SELECT avg(size) FROM s)), 6) AS heat FROM s", "coms"))
def a17(spark, sf):
    return D.density_heat(I.communities(spark, sf)).select("com", F.round("heat", 6).alias("heat"))


_PEACH = "each AS (SELECT id, unnest(ids) AS identity FROM pids)"


@query("A20_neighbour_identities", sql(f"AND {_PEACH}, touched AS (SELECT DISTINCT b AS id FROM sym WHERE a IN (SELECT id FROM each WHERE identity = 'L1')), tot AS (SELECT identity, count(*) AS t FROM each GROUP BY 1), n AS (SELECT identity, count(*) AS n FROM each WHERE id IN (SELECT id FROM touched) GROUP BY 1) SELECT identity, coalesce(n, 0) AS n, round(coalesce(n, 0) / t, 9) AS share FROM tot LEFT JOIN n USING (identity)", "sym", "pids"))
def a20(spark, sf):
    return D.neighbour_identities(E.collapse(I.near(spark, sf)), I.point_identities(spark, sf), "L1").withColumn("share", F.round("share", 9))


@query("A22_neighbour_vectors", sql(f"AND {_PEACH}, c AS (SELECT a AS id, identity, count(*) AS n FROM sym JOIN each ON each.id = b GROUP BY 1, 2) SELECT id, identity, round(n / sum(n) OVER (PARTITION BY id), 9) AS share FROM c", "sym", "pids"))
def a22(spark, sf):
    return D.neighbour_vectors(E.collapse(I.near(spark, sf)), I.point_identities(spark, sf)).withColumn("share", F.round("share", 9))


@query("C6_heat_matrix", sql(f"AND {_COMP} SELECT com, round(max(share) FILTER (identity = 'AFRICA'), 9) AS \"AFRICA\", round(max(share) FILTER (identity = 'ASIA'), 9) AS \"ASIA\", round(max(share) FILTER (identity = 'credit'), 9) AS credit, CASE WHEN com = 0 THEN 4611686018427387904 ELSE com END AS at FROM comp GROUP BY com", "idents", "coms"))
def c6(spark, sf):
    wide = D.heat_matrix(D.composition(I.communities(spark, sf), I.identities(spark, sf)).withColumn("share", F.round("share", 9)), "com", "identity", "share")
    return wide.select("com", "AFRICA", "ASIA", "credit", "at")


@query("X_classify_first", "SELECT p_partkey AS id, CASE WHEN p_type LIKE '%STEEL%' AND p_type NOT LIKE '%SMALL%' THEN 'steel' WHEN p_type LIKE '%BRASS%' THEN 'brass' ELSE 'rest' END AS ids FROM part")
def classify_first(spark, sf):
    rules = [("steel", ["STEEL"], ["SMALL"]), ("brass", ["BRASS"], []), ("rest", [], [])]
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(D.classify(F.col("p_type"), rules), ",").alias("ids"))


@query("X_classify_all", "SELECT id, ids FROM (SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' END, CASE WHEN p_type LIKE '%SMALL%' THEN 'small' END], lambda x: x IS NOT NULL), ',') AS ids FROM part) WHERE ids <> ''")
def classify_all(spark, sf):
    rules = [("steel", ["STEEL"], []), ("small", ["SMALL"], [])]
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), D.classify(F.col("p_type"), rules, hierarchical=False).alias("ids")).where("ids IS NOT NULL").select("id", F.array_join("ids", ",").alias("ids"))


@query("X_remap", sql("SELECT id, array_to_string(list_filter(list_transform(ids, lambda x: CASE WHEN x = 'ASIA' THEN 'EAST' WHEN x = 'AMERICA' THEN 'WEST' ELSE x END), lambda x: x IN ('EAST', 'WEST', 'credit')), ',') AS ids FROM idents WHERE list_has_any(ids, ['ASIA', 'AMERICA', 'credit'])", "idents"))
def remap(spark, sf):
    mapping = spark.createDataFrame([("ASIA", "EAST"), ("AMERICA", "WEST")], "identity string, to string")
    return D.remap(I.identities(spark, sf), mapping, ["EAST", "WEST", "credit"]).select("id", F.array_join("ids", ",").alias("ids"))
