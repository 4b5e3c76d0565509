"""Registered queries on significance tests, clustering and scalar functions."""

from __future__ import annotations


from pyspark.sql import functions as F

from .. import inputs as I
from ..functions import scalar as X
from ..inputs import sql, table
from ..operators import cluster as K
from ..operators.embedding import embed
from ..operators import stats as T
from ..operators.ranks import numbered
from ..registry import query


def row(spark, values: dict, digits: int = 6):
    return spark.createDataFrame([tuple(round(float(v), digits) if not isinstance(v, str) else v for v in values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items()))


def quantities(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("column"), F.col("l_quantity").alias("value"))


_M = "m AS (SELECT l_returnflag AS f, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM m WHERE f = 'A'), b AS (SELECT * FROM m WHERE f = 'R')"


@query("T1_student", f"WITH {_M}, s AS (SELECT a.n + b.n - 2 AS df, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t FROM a, b) SELECT round(t, 6) AS t, CAST(df AS DOUBLE) AS df FROM s")
def t1(spark, sf):
    r = T.t_test(quantities(spark, sf), "A", "R")
    return row(spark, {k: r[k] for k in ("t", "df")})


@query("T1_welch", f"WITH {_M} SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 4) AS df FROM a, b")
def t1w(spark, sf):
    r = T.t_test(quantities(spark, sf), "A", "R", welch=True)
    return row(spark, {"t": r["t"], "df": round(r["df"], 4)})


@query("T1_paired", "SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM (SELECT l_tax - l_discount AS d FROM lineitem)")
def t1p(spark, sf):
    r = T.paired_t_test(table(spark, sf, "lineitem"), "l_tax", "l_discount")
    return row(spark, {k: r[k] for k in ("t", "df")})


@query("T2_anova", "WITH m AS (SELECT l_returnflag AS f, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), g AS (SELECT sum(n * m) / sum(n) AS g, sum(n) AS n, count(*) AS k FROM m) SELECT round(sum(m.n * (m.m - g.g) ** 2) / (any_value(g.k) - 1) / (sum((m.n - 1) * m.v) / (any_value(g.n) - any_value(g.k))), 6) AS f, CAST(any_value(g.k) - 1 AS DOUBLE) AS df_between, CAST(any_value(g.n) - any_value(g.k) AS DOUBLE) AS df_within FROM m, g")
def t2(spark, sf):
    r = T.anova(quantities(spark, sf))
    return row(spark, {k: r[k] for k in ("f", "df_between", "df_within")})


@query("T3_mann_whitney", "WITH v AS (SELECT l_returnflag AS f, l_quantity AS q FROM lineitem WHERE l_returnflag IN ('A', 'R')), r AS (SELECT f, q, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS k FROM v) SELECT round(sum(k) FILTER (f = 'A') - count(*) FILTER (f = 'A') * (count(*) FILTER (f = 'A') + 1) / 2.0, 3) AS u, round(avg(k) FILTER (f = 'A'), 4) AS mean_rank_a, round(avg(k) FILTER (f = 'R'), 4) AS mean_rank_b FROM r")
def t3(spark, sf):
    r = T.mann_whitney(quantities(spark, sf), "A", "R")
    return row(spark, {"u": round(r["u"], 3), "mean_rank_a": round(r["mean_rank_a"], 4), "mean_rank_b": round(r["mean_rank_b"], 4)})


@query("T4_pearson", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(corr(l_quantity, l_extendedprice) ** 2, 6) AS r2, CASE WHEN abs(corr(l_quantity, l_extendedprice)) < 0.1 THEN 'negligible' WHEN abs(corr(l_quantity, l_extendedprice)) < 0.3 THEN 'weak' WHEN abs(corr(l_quantity, l_extendedprice)) < 0.5 THEN 'moderate' WHEN abs(corr(l_quantity, l_extendedprice)) < 0.7 THEN 'strong' ELSE 'very strong' END AS strength FROM lineitem")
def t4(spark, sf):
    r = T.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return row(spark, {k: r[k] for k in ("r", "r2", "strength")})


@query("T5_shapiro")
def t5(spark, sf):
    values = table(spark, sf, "supplier").select(F.lit("b").alias("column"), F.col("s_acctbal").alias("value"))
    return row(spark, T.shapiro_wilk(values, "b"))


@query("T6_chi_square", "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS cb FROM c GROUP BY 1), t AS (SELECT sum(o) AS t FROM c), g AS (SELECT coalesce(o, 0) AS o, ra * cb / t AS e FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (a, b)) SELECT round(sum((o - e) ** 2 / e), 4) AS chi2, CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS DOUBLE) AS dof, round(sqrt(sum((o - e) ** 2 / e) / (SELECT t FROM t)), 6) AS v FROM g")
def t6(spark, sf):
    r = T.chi_square(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return row(spark, {"chi2": round(r["chi2"], 4), "dof": r["dof"], "v": r["v"]})


@query("T7_cleaned", "SELECT 'a' AS \"column\", CAST(s_acctbal AS DOUBLE) AS value FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'b', CAST(s_suppkey AS DOUBLE) FROM supplier WHERE s_suppkey % 3 <> 0")
def t7(spark, sf):
    k = F.col("s_suppkey")
    df = table(spark, sf, "supplier").select(F.when(k % 4 == 0, F.col("s_acctbal").cast("string")).when(k % 4 == 1, "x").when(k % 4 == 2, "nan").alias("a"), F.when(k % 3 == 0, F.col("s_name")).otherwise(k.cast("string")).alias("b"))
    return T.cleaned(df, "a", "b")


@query("T8_spread", "SELECT l_returnflag AS \"column\", count(*) AS n, round(quantile_cont(l_quantity, 0.25), 6) AS q1, round(median(l_quantity), 6) AS median, round(quantile_cont(l_quantity, 0.75), 6) AS q3, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 6) AS iqr FROM lineitem GROUP BY 1")
def t8(spark, sf):
    return T.spread(quantities(spark, sf)).select("column", "n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "iqr")])


@query("A26_histogram_slopes", "WITH b AS (SELECT unnest(generate_series(0, 9)) AS bin), c AS (SELECT least(9, CAST(floor(l_quantity / 5.1) AS INT)) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 51 GROUP BY 1), n AS (SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)) SELECT CAST(bin AS INT) AS bin, n, CAST(coalesce(lead(n) OVER (ORDER BY bin) - n, 0) AS BIGINT) AS slope FROM n")
def a26(spark, sf):
    return T.histogram_slopes(quantities(spark, sf), 0.0, 51.0, 10).na.fill(0, ["slope"])


@query("A28_normalised_labels", "SELECT s_suppkey AS id, round((s_acctbal - (SELECT min(s_acctbal) FROM supplier WHERE s_suppkey % 3 = 0)) / (SELECT stddev_pop(s_acctbal) FROM supplier), 6) AS score FROM supplier")
def a28(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))
    return T.normalised_labels(s, s.where("id % 3 = 0")).withColumn("score", F.round("score", 6))


def compositions(spark, sf):
    from ..operators.identity import composition, heat_matrix

    return heat_matrix(composition(I.communities(spark, sf), I.identities(spark, sf)), "com", "identity", "share")


@query("C1_kmeans")
def c1(spark, sf):
    df = compositions(spark, sf)
    return K.kmeans(df, [c for c in df.columns if c not in ("com", "at")], 3).select("com", "cluster")


@query("C2_auto_kmeans")
def c2(spark, sf):
    df = compositions(spark, sf)
    return K.auto_kmeans(df, [c for c in df.columns if c not in ("com", "at")]).select("com", "cluster")


@query("C3_dbscan", sql("AND n AS (SELECT i, j, d2 FROM pairs WHERE d2 <= 3600 UNION ALL SELECT id, id, 0 FROM cent), core AS (SELECT i AS id FROM n GROUP BY 1 HAVING count(*) >= 5), cl AS (SELECT i, j FROM n WHERE i IN (SELECT id FROM core) AND j IN (SELECT id FROM core)), r(s, t) AS (SELECT id, id FROM core UNION SELECT s, j FROM r JOIN cl ON t = i), c AS (SELECT s AS id, dense_rank() OVER (ORDER BY min(t)) AS cluster FROM r GROUP BY 1), e AS (SELECT i AS id, arg_min(cluster, struct_pack(d := d2, j := j)) AS cluster FROM n JOIN c ON c.id = j GROUP BY 1) SELECT cent.id, coalesce(cluster, 0) AS cluster FROM cent LEFT JOIN e ON e.id = cent.id", "pairs", recursive=True))
def c3(spark, sf):
    return K.dbscan(I.centroids(spark, sf), 60.0, 5)


@query("C3_dbscan_settings", sql("AND k AS (SELECT i, sqrt(d2) AS d, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS r FROM pairs) SELECT round(quantile_cont(d, 0.8), 6) AS eps, CAST(greatest(3, floor(0.2 * sqrt((SELECT count(*) FROM cent)))) AS INT) AS least FROM k WHERE r = 4", "pairs"))
def c3s(spark, sf):
    eps, least = K.dbscan_settings(I.centroids(spark, sf))
    return spark.createDataFrame([(round(eps, 6), least)], "eps double, least int")


@query("C5_group_by_intensity")
def c5(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").pivot("event_type").agg(F.avg("value")).na.fill(0.0)
    return K.kmeans(e, [c for c in e.columns if c != "user_id"], 4).select("user_id", "cluster")


@query("P11_embedding")
def p11(spark, sf):
    df = compositions(spark, sf)
    return embed(df, [c for c in df.columns if c not in ("com", "at")]).select("com", F.col("embedding")[0].alias("px"), F.col("embedding")[1].alias("py"))


@query("P11_centroid_map")
def p11c(spark, sf):
    return embed(I.centroids(spark, sf), ["z", "y", "x"]).select("id", F.col("embedding")[0].alias("px"), F.col("embedding")[1].alias("py"))


@query("X_arcsinh", "SELECT event_id, round(asinh(value / 150.0), 9) AS v FROM events")
def x_arcsinh(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(X.arcsinh(F.col("value")), 9).alias("v"))


@query("X_kernel_size", "SELECT DISTINCT p_size, CAST(2 * round_even(p_size / 1.5, 0) + 1 AS BIGINT) AS k FROM part")
def x_kernel(spark, sf):
    return table(spark, sf, "part").select("p_size", X.kernel_size(F.col("p_size").cast("double"), 1.5).alias("k")).distinct()


@query("X_blue_white_red", "WITH t AS (SELECT s_suppkey AS id, CASE WHEN s_acctbal >= 2000 THEN (s_acctbal - 2000) / 8000 ELSE (s_acctbal - 2000) / 3000 END AS t FROM supplier), c AS (SELECT id, greatest(-1, least(1, t)) AS t FROM t) SELECT id, CAST(CASE WHEN t >= 0 THEN 255 ELSE round_even(255 * (1 - abs(t)), 0) END AS INT) AS r, CAST(round_even(255 * (1 - abs(t)), 0) AS INT) AS g, CAST(CASE WHEN t >= 0 THEN round_even(255 * (1 - abs(t)), 0) ELSE 255 END AS INT) AS b FROM c")
def x_bwr(spark, sf):
    c = X.blue_white_red(F.col("s_acctbal"), F.lit(-1000.0), F.lit(10000.0), F.lit(2000.0))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), c.alias("c")).select("id", F.col("c")[0].alias("r"), F.col("c")[1].alias("g"), F.col("c")[2].alias("b"))


@query("X_distinct_colours", "WITH h AS (SELECT n_nationkey, 6.0::DOUBLE * (row_number() OVER (ORDER BY n_nationkey) - 1) / count(*) OVER () AS h FROM nation) SELECT n_nationkey, CAST(round_even(255 * greatest(0, least(1, abs(h - 3) - 1)), 0) AS INT) AS r, CAST(round_even(255 * greatest(0, least(1, abs((h + 4) % 6 - 3) - 1)), 0) AS INT) AS g, CAST(round_even(255 * greatest(0, least(1, abs((h + 2) % 6 - 3) - 1)), 0) AS INT) AS b FROM h")
def x_colours(spark, sf):
    return X.distinct_colours(table(spark, sf, "nation"), "n_nationkey")


_RGB = [f"CAST(p_partkey * {m} % 256 AS INT)" for m in (37, 91, 151)]


@query("X_nearest_colour", "WITH c(name, x, y, z) AS (VALUES " + ", ".join(str(c) for c in X.COLOURS) + f"), p AS (SELECT p_partkey AS id, {_RGB[0]} AS r, {_RGB[1]} AS g, {_RGB[2]} AS b FROM part) SELECT id, arg_min(name, struct_pack(d := (r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z), n := name)) AS colour FROM p, c GROUP BY 1")
def x_nearest(spark, sf):
    at = lambda m: F.col("p_partkey") * m % 256
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.nearest_colour(at(37), at(91), at(151)).alias("colour"))


@query("X_matches", "SELECT p_partkey AS id FROM part WHERE p_type LIKE '%STEEL%' AND p_type LIKE '%A%' AND p_type NOT LIKE '%SMALL%'")
def x_matches(spark, sf):
    return table(spark, sf, "part").where(X.matches(F.col("p_type"), ["STEEL", "A"], ["SMALL"])).select(F.col("p_partkey").alias("id"))


@query("X_base_name", "SELECT p_partkey AS id, 'im' || p_partkey AS name FROM part")
def x_base(spark, sf):
    path = F.concat(F.lit("/data/set/im"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".tif").otherwise(".TIFF"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.base_name(path).alias("name"))


@query("X_natural_order", "SELECT s_name, row_number() OVER (ORDER BY CAST(nullif(regexp_extract(s_name, '(\\d+)', 1), '') AS HUGEINT), s_name) AS at FROM supplier")
def x_natural(spark, sf):
    return numbered(table(spark, sf, "supplier").select("s_name"), X.natural_key(F.col("s_name")), start=1, name="at")


@query("X_log1p", "SELECT event_id, round(ln(1 + value), 9) AS v FROM events WHERE value IS NOT NULL")
def x_log(spark, sf):
    return table(spark, sf, "events").where("value IS NOT NULL").select("event_id", F.round(F.log1p("value"), 9).alias("v"))


