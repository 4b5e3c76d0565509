"""Registered queries on centroids."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import inputs as I
from ..inputs import sql
from ..model import Scale
from ..operators import edges as E
from ..operators import spatial as S
from ..registry import query

_KNN = "SELECT i, j, d2, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS r FROM pairs"


@query("J3_radius_network", sql("SELECT i AS node_a, j AS node_b, 0 AS edge_c FROM pairs WHERE d2 <= 3600", "pairs"))
def j3(spark, sf):
    return S.radius_network(I.centroids(spark, sf), 60.0)


@query("J3_radius_of_targets", sql("SELECT i AS node_a, j AS node_b, 0 AS edge_c FROM pairs WHERE d2 <= 3600 AND i % 4 = 0", "pairs"))
def j3t(spark, sf):
    return S.radius_network(I.centroids(spark, sf), 60.0, I.centroids(spark, sf).where("id % 4 = 0"))


@query("J4_nearest_network", sql(f"SELECT i AS node_a, j AS node_b, 0 AS edge_c FROM ({_KNN}) WHERE r <= 3", "pairs"))
def j4(spark, sf):
    return S.nearest_network(I.centroids(spark, sf), 3)


@query("J4_nearest_within", sql(f"SELECT i AS node_a, j AS node_b, 0 AS edge_c FROM ({_KNN}) WHERE r <= 3 AND d2 <= 1600", "pairs"))
def j4r(spark, sf):
    return S.nearest_network(I.centroids(spark, sf), 3, 40.0)


_TRUNC = "tr AS (SELECT id, CAST(trunc(z * 2.0) AS INT) AS z, y, x FROM cent), tp AS (SELECT a.id AS i, b.id AS j FROM tr a JOIN tr b ON a.id < b.id WHERE (a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 6400)"


@query("J5_proximity_network", sql(f"AND {_TRUNC} SELECT i AS node_a, j AS node_b FROM tp", "cent"))
def j5(spark, sf):
    rows = S.proximity_network(I.centroids(spark, sf), 40.0, Scale(0.5, 1.0))
    return rows.select(F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b"))


@query("J8_nearest_distances", sql(f"SELECT i AS id, round(avg(sqrt(d2)), 6) AS dist FROM ({_KNN}) WHERE r <= 2 GROUP BY 1", "pairs"))
def j8(spark, sf):
    c = I.centroids(spark, sf)
    return S.nearest_distances(c, c, 2).select("id", F.round("dist", 6).alias("dist"))


@query("J8_cross_distances", sql("SELECT i AS id, round(sqrt(min(d2)), 6) AS dist FROM pairs WHERE i % 2 = 0 AND j % 2 = 1 GROUP BY 1", "pairs"))
def j8c(spark, sf):
    c = I.centroids(spark, sf)
    return S.nearest_distances(c.where("id % 2 = 0"), c.where("id % 2 = 1")).select("id", F.round("dist", 6).alias("dist"))


@query("J10_identity_distances", sql("AND each AS (SELECT id, unnest(ids) AS identity FROM pids), d AS (SELECT i, identity AS target, sqrt(min(d2)) AS dist FROM pairs JOIN each ON each.id = j GROUP BY 1, 2) SELECT identity AS root, target, round(avg(dist), 6) AS dist FROM d JOIN each ON each.id = i GROUP BY 1, 2", "pairs", "pids"))
def j10(spark, sf):
    return S.identity_distances(I.centroids(spark, sf), I.point_identities(spark, sf)).withColumn("dist", F.round("dist", 6))


_GRID = "grid AS (SELECT CAST(a AS INT) AS z, CAST(b AS INT) AS y, CAST(c AS INT) AS x FROM (SELECT unnest(generate_series(-200, 200, 100)) AS a), (SELECT unnest(generate_series(-200, 200, 50)) AS b), (SELECT unnest(generate_series(-200, 200, 50)) AS c))"


@query("J11_nearest_label", sql(f"AND {_GRID} SELECT g.z, g.y, g.x, arg_min(id, struct_pack(d := (g.z - c.z) * (g.z - c.z) + (g.y - c.y) * (g.y - c.y) + (g.x - c.x) * (g.x - c.x), i := id)) AS label FROM grid g, cent c GROUP BY 1, 2, 3", "cent"))
def j11(spark, sf):
    axis = lambda n, step: spark.range(-200, 201, step).select(F.col("id").cast("int").alias(n))
    grid = axis("z", 100).crossJoin(F.broadcast(axis("y", 50))).crossJoin(F.broadcast(axis("x", 50)))
    return S.nearest_label(grid, I.centroids(spark, sf))


@query("A12_radial", sql("AND d AS (SELECT sqrt(d2) AS d FROM pairs WHERE i < j AND d2 <= 2500), b AS (SELECT unnest(generate_series(0, CAST((SELECT floor(max(d) / 5) FROM d) AS BIGINT))) AS i) SELECT (i + 1) * 5e0 AS r, round(2 * count(d) / (SELECT max(id) FROM cent), 9) AS value FROM b LEFT JOIN d ON d >= i * 5 AND d <= (i + 1) * 5 GROUP BY i", "pairs"))
def a12(spark, sf):
    return S.radial_distribution(I.centroids(spark, sf), E.collapse(I.near(spark, sf)), 5.0).withColumn("value", F.round("value", 9))


@query("A19_nearest_heat", sql("SELECT i AS id, round(ln(25.0 / sqrt(min(d2))), 6) AS heat FROM pairs GROUP BY 1", "pairs"))
def a19(spark, sf):
    c = I.centroids(spark, sf)
    return S.nearest_heat(S.nearest_distances(c, c), 25.0).select("id", F.round("heat", 6).alias("heat"))


_RS = [20.0 + i * (200.0 - 20.0) / 9 for i in range(10)]
_RIPLEY = "rs AS (SELECT unnest([" + ", ".join(map(repr, _RS)) + "]::DOUBLE[]) AS r)"


@query("P1_ripley_k", sql(f"AND {_RIPLEY}, n AS (SELECT count(*) AS n FROM cent) SELECT round(r, 6) AS r, round((SELECT count(*) FROM pairs WHERE sqrt(d2) <= r) / (n * (n / 64000000.0)), 4) AS k FROM rs, n", "pairs"))
def p1(spark, sf):
    c = I.centroids(spark, sf)
    return S.ripley_k(c, c, S.radii((400.0, 400.0, 400.0), 20.0), 400.0**3).select(F.round("r", 6).alias("r"), F.round("k", 4).alias("k"))


@query("P2_ripley_h", sql(f"AND {_RIPLEY}, n AS (SELECT count(*) AS n FROM cent), k AS (SELECT r, (SELECT count(*) FROM pairs WHERE sqrt(d2) <= r) / (n * (n / 64000000.0)) AS k FROM rs, n) SELECT round(r, 6) AS r, round(cbrt(k / (4 * pi() / 3)) - r, 5) AS h FROM k", "pairs"))
def p2(spark, sf):
    c = I.centroids(spark, sf)
    return S.ripley_h(S.ripley_k(c, c, S.radii((400.0, 400.0, 400.0), 20.0), 400.0**3)).select(F.round("r", 6).alias("r"), F.round("h", 5).alias("h"))


@query("P3_radii", sql("AND t AS (SELECT CAST(0.5 * least(max(z) - min(z), max(y) - min(y), max(x) - min(x)) AS DOUBLE) AS most FROM cent), n AS (SELECT most, CAST(floor(most / 20) AS INT) AS n FROM t) SELECT round(20.0::DOUBLE + i * (most - 20.0::DOUBLE) / (n - 1), 6) AS r FROM n, (SELECT unnest(range(1000)) AS i) WHERE i < n", "cent"))
def p3(spark, sf):
    sides = I.centroids(spark, sf).agg(*[(F.max(a) - F.min(a)).cast("double") for a in "zyx"]).first()
    return spark.createDataFrame([(r,) for r in S.radii(tuple(sides), 20.0)], "r double").select(F.round("r", 6).alias("r"))


_BOX = "lim AS (SELECT min(z) AS lz, min(y) AS ly, max(z) - min(z) AS sz, max(y) - min(y) AS sy FROM cent), box AS (SELECT id, z - lz AS z, y - ly AS y, sz, sy FROM cent, lim)"
_DIRS = "dirs AS (SELECT a, b FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b))"
_MIRROR = "SELECT id, CAST(CASE a WHEN -1 THEN -z WHEN 1 THEN 2 * sz - z ELSE z END AS DOUBLE) AS z, CAST(CASE b WHEN -1 THEN -y WHEN 1 THEN 2 * sy - y ELSE y END AS DOUBLE) AS y FROM box, dirs WHERE (a = 0 OR CASE a WHEN -1 THEN z ELSE sz - z END < {most}) AND (b = 0 OR CASE b WHEN -1 THEN y ELSE sy - y END < {most})"


def _box(spark, sf):
    """All centroids in the plane of z and y, from their least coordinates on, and the sides of their bounds."""
    c = I.centroids(spark, sf)
    b = c.agg(*[f(a) for a in "zy" for f in (F.min, F.max)]).first()
    return c.select("id", (F.col("z") - b[0]).alias("z"), (F.col("y") - b[2]).alias("y")), (float(b[1] - b[0]), float(b[3] - b[2]))


@query("P4_mirrored", sql(f"AND {_BOX}, {_DIRS} {_MIRROR.format(most=400)}", "cent"))
def p4(spark, sf):
    points, sides = _box(spark, sf)
    return S.mirrored(points, sides, 400.0, ("z", "y"))


@query("P5_ripley", sql(f"AND {_BOX}, {_DIRS}, top AS (SELECT CAST(sz AS DOUBLE) AS sz, CAST(sy AS DOUBLE) AS sy, least(sz, sy) * 0.4::DOUBLE AS most FROM lim), mir AS ({_MIRROR.format(most='(SELECT most FROM top)')}), roots AS (SELECT z, y FROM box WHERE z > 0.1::DOUBLE * sz AND z < sz - 0.1::DOUBLE * sz AND y > 0.1::DOUBLE * sy AND y < sy - 0.1::DOUBLE * sy), num AS (SELECT *, CAST(floor(most / 50) AS INT) AS n FROM top), rs AS (SELECT 50.0::DOUBLE + i * (most - 50.0::DOUBLE) / (n - 1) AS r FROM num, (SELECT unnest(range(1000)) AS i) WHERE i < n), d AS (SELECT (a.z - m.z) * (a.z - m.z) + (a.y - m.y) * (a.y - m.y) AS d2, count(*) AS n FROM roots a, mir m GROUP BY 1), k AS (SELECT r, ((SELECT sum(n) FROM d WHERE sqrt(d2) <= r) - (SELECT count(*) FROM roots)) / ((SELECT count(*) FROM box) * (SELECT count(*) FROM roots) / (SELECT sz * sy FROM top)) AS k FROM rs) SELECT round(r, 6) AS r, round(k, 3) AS k, round(sqrt(k / pi()) - r, 4) AS h, round(pi() * r * r, 3) AS theory FROM k", "cent"))
def p5(spark, sf):
    points, (height, width) = _box(spark, sf)
    out = S.ripley(points.withColumn("x", F.lit(0)), (height, width, 1), 50.0, proportion=0.4, border=0.1, mirror=True)
    return out.select(F.round("r", 6).alias("r"), F.round("k", 3).alias("k"), F.round("h", 4).alias("h"), F.round("theory", 3).alias("theory"))


_LH = ", ".join(f"min({a}) AS l{a}, max({a}) AS h{a}" for a in "zyx")
_N = {a: f"greatest(1, ceil((h{a} - l{a}) / 90.0))" for a in "zyx"}
_AT = {a: f"least({_N[a]} - 1, floor(({a} - l{a}) / 90.0))" for a in "zyx"}


@query("P6_grid_cells", sql(f"SELECT id, CAST(({_AT['z']} * {_N['y']} + {_AT['y']}) * {_N['x']} + {_AT['x']} + 1 AS BIGINT) AS cell FROM cent, (SELECT {_LH} FROM cent)", "cent"))
def p6(spark, sf):
    return S.grid_cells(I.centroids(spark, sf), 90)


_HEX = "seeds AS (SELECT q, r, 60.0 * 1.5 * q AS sx, 60.0 * (sqrt(3.0) / 2 * q + sqrt(3.0) * r) AS sy FROM (SELECT unnest(generate_series(-12, 12)) AS q), (SELECT unnest(generate_series(-14, 14)) AS r))"


@query("P7_hexagon_cells", sql(f"AND {_HEX} SELECT id, min(struct_pack(d := round((x - sx) * (x - sx) + (y - sy) * (y - sy), 6), q := q, r := r)).q AS q, min(struct_pack(d := round((x - sx) * (x - sx) + (y - sy) * (y - sy), 6), q := q, r := r)).r AS r FROM cent, seeds GROUP BY id", "cent"))
def p7(spark, sf):
    return S.hexagon_cells(I.centroids(spark, sf), 60.0)


@query("P7_prism_cells", sql(f"AND {_HEX} SELECT id, min(struct_pack(d := round((x - sx) * (x - sx) + (y - sy) * (y - sy), 6), q := q, r := r)).q AS q, min(struct_pack(d := round((x - sx) * (x - sx) + (y - sy) * (y - sy), 6), q := q, r := r)).r AS r, CAST(floor(any_value(z) / 50.0) AS BIGINT) AS layer FROM cent, seeds GROUP BY id", "cent"))
def p7p(spark, sf):
    return S.prism_cells(I.centroids(spark, sf), 60.0, 50.0)


_FCC = "dodec AS (SELECT a, b, c FROM (SELECT unnest(generate_series(-16, 16)) AS a), (SELECT unnest(generate_series(-16, 16)) AS b), (SELECT unnest(generate_series(-16, 16)) AS c) WHERE (a + b + c) % 2 = 0)"
_BEST = "min(struct_pack(d := round((z / 80.0 - a) ** 2 + (y / 80.0 - b) ** 2 + (x / 80.0 - c) ** 2, 9), a := a, b := b, c := c))"


@query("P7_dodecahedron_cells", sql(f"AND {_FCC}, m AS (SELECT id, {_BEST} AS m FROM cent JOIN dodec ON abs(z / 80.0 - a) < 2 AND abs(y / 80.0 - b) < 2 AND abs(x / 80.0 - c) < 2 GROUP BY 1) SELECT id, m.a AS a, m.b AS b, m.c AS c FROM m", "cent"))
def p7d(spark, sf):
    return S.dodecahedron_cells(I.centroids(spark, sf), 80.0)


@query("P8_expected_nearest", sql("AND n AS (SELECT count(*) AS n, 24 * 60 * 60 AS total FROM (SELECT DISTINCT label FROM vox)), p AS (SELECT n // 2 * (total // n) AS m, total // n AS step, total FROM n), spot AS (SELECT i, i // 3600 * 2.0 AS z, i // 60 % 60 AS y, i % 60 AS x FROM (SELECT unnest([m, m - step, m + step]) AS i, total FROM p) WHERE i BETWEEN 0 AND total - 1) SELECT round(min(sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2)), 9) AS distance FROM spot a JOIN spot b ON a.i <> b.i AND a.i = (SELECT m FROM p)", "vox"))
def p8(spark, sf):
    n = I.voxels(spark, sf).select("label").distinct().count()
    return spark.createDataFrame([(round(S.expected_nearest(n, (24, 60, 60), Scale(1.0, 2.0)), 9),)], "distance double")


@query("P10_centroid_image", sql("SELECT CAST(z - lz AS INT) AS z, CAST(y - ly AS INT) AS y, CAST(x - lx AS INT) AS x, max(id) AS label FROM cent, (SELECT min(z) AS lz, min(y) AS ly, min(x) AS lx FROM cent) GROUP BY 1, 2, 3", "cent"))
def p10(spark, sf):
    return S.centroid_image(I.centroids(spark, sf), clip=True)


@query("N9_scrambled")
def n9(spark, sf):
    return S.scrambled(I.centroids(spark, sf))


@query("X_angle", sql("SELECT a.id, round(degrees(acos(greatest(-1.0, least(1.0, ((a.z - b.z) * (c.z - b.z) + (a.y - b.y) * (c.y - b.y) + (a.x - b.x) * (c.x - b.x)) / (sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2) * sqrt((c.z - b.z) ** 2 + (c.y - b.y) ** 2 + (c.x - b.x) ** 2)))))), 5) AS degrees FROM cent a JOIN cent b ON b.id = a.id + 1 JOIN cent c ON c.id = a.id + 2", "cent"))
def x_angle(spark, sf):
    c = I.centroids(spark, sf)
    at = lambda n, d: c.select((F.col("id") - d).alias("id"), F.struct("z", "y", "x").alias(n))
    return S.angle(at("p", 0).join(at("q", 1), "id").join(at("r", 2), "id")).withColumn("degrees", F.round("degrees", 5))
