"""Registered queries on sources, sinks, streams and filament repair: each writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import inputs as I
from ..helpers import settle, shared_dir
from ..inputs import sql, table
from ..model import Scale, SpatialNetwork
from ..operators import blockwise as B
from ..operators import chains
from ..operators import edges as E
from ..operators import tracing as R
from ..operators.distance import squared_depths
from ..registry import query
from ..sources import nifti
from ..sources import tables as T
from ..sources import tiff
from ..streaming import edges as S
from .voxel_queries import depth, nodes, SHAPE, skeleton


@query("S1_network_file", sql("SELECT node_a, node_b, edge_c FROM edges", "edges"))
def s1(spark, sf):
    path = shared_dir(spark, "network")
    T.write_network(I.edges(spark, sf), path)
    return T.read_network(spark, path)


@query("S1_stacked_groups", "SELECT s_suppkey AS node_a, CAST(s_nationkey AS BIGINT) AS node_b, 5 AS edge_c FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100, 0 FROM supplier WHERE s_suppkey % 2 = 1")
def s1g(spark, sf):
    path, k = shared_dir(spark, "groups"), F.col("s_suppkey")
    text = lambda c: c.cast("string")
    first = [F.when(k % 7 == 0, "a").otherwise(text(k)).alias("a"), text(F.col("s_nationkey")).alias("b"), F.lit("5").alias("c")]
    second = [F.when(k % 2 == 1, text(k + 1000)).alias("d"), F.when(k % 2 == 1, text(F.col("s_nationkey") + 100)).alias("e"), F.when(k % 3 == 0, "x").alias("f")]
    T.write_csv(table(spark, sf, "supplier").select(*first, *second), path, ["Node A", "Node B", "Edge C", "Node A2", "Node B2", "Edge C2"])
    return T.read_network(spark, path)


@query("S2_centroid_file", sql("SELECT * FROM cent", "cent"))
def s2(spark, sf):
    path = shared_dir(spark, "centroids")
    T.write_centroids(I.centroids(spark, sf), path)
    return T.read_centroids(spark, path)


@query("S3_identity_file", sql("SELECT id, array_to_string(ids, '|') AS ids FROM idents", "idents"))
def s3(spark, sf):
    path = shared_dir(spark, "identities")
    T.write_identities(I.identities(spark, sf), path)
    return T.read_identities(spark, path).select("id", F.array_join("ids", "|").alias("ids"))


@query("S3_community_file", sql("SELECT * FROM coms", "coms"))
def s3c(spark, sf):
    path = shared_dir(spark, "communities")
    T.write_communities(I.communities(spark, sf), path)
    return T.read_communities(spark, path)


@query("S5_tiff_round_trip", sql("SELECT z, y, x, label FROM vox", "vox"))
def s5(spark, sf):
    folder = shared_dir(spark, "tiff")
    written = tiff.write_voxels(nodes(spark, sf), folder, SHAPE).count()
    layer = F.regexp_extract("file", r"layer-(\d+)", 1).cast("int")
    return tiff.read_voxels(spark, folder).select(layer.alias("z"), "y", "x", "label").where(F.lit(written) > 0)


@query("S6_nifti_round_trip", sql("SELECT z, y, x, label FROM vox", "vox"))
def s6(spark, sf):
    folder = shared_dir(spark, "nifti")
    written = nifti.write_voxels(nodes(spark, sf), folder, SHAPE).count()
    layer = F.regexp_extract("file", r"layer-(\d+)", 1).cast("int")
    return nifti.read_voxels(spark, folder).select(layer.alias("z"), "y", "x", "label").where(F.lit(written) > 0)


@query("S6_pictures", sql("SELECT z, y, x, floor(least(value, 255)) AS value FROM chan WHERE value >= 1", "chan"))
def s6p(spark, sf):
    folder = shared_dir(spark, "pictures")
    written = T.write_pictures(I.channel(spark, sf), folder, SHAPE).count()
    layer = F.regexp_extract("file", r"layer-(\d+)", 1).cast("int")
    return T.read_pictures(spark, folder).select(layer.alias("z"), "y", "x", "value").where(F.lit(written) > 0)


@query("S7_scale_file", "SELECT count(*) / 8::DOUBLE AS xy, count(*) / 4::DOUBLE AS z FROM supplier")
def s7(spark, sf):
    path = shared_dir(spark, "scale")
    n = table(spark, sf, "supplier").agg(F.count("*").alias("n"))
    lines = F.array(F.concat(F.lit("xy_scale: "), (F.col("n") / 8).cast("string")), F.concat(F.lit("z_scale: "), (F.col("n") / 4).cast("string")))
    n.select(F.explode(lines).alias("value")).coalesce(1).write.text(path)
    s = T.read_scale(spark, path)
    return spark.createDataFrame([(s.xy, s.z)], "xy double, z double")


@query("S8_session", sql("SELECT count(*) AS edges, (SELECT count(*) FROM cent) AS centroids, 24 AS nz FROM near", "near", "cent"))
def s8(spark, sf):
    folder = shared_dir(spark, "session")
    SpatialNetwork(edges=I.near(spark, sf), centroids=I.centroids(spark, sf), scale=Scale(0.5, 2.0), shape=SHAPE).save(folder)
    n = SpatialNetwork.load(spark, folder)
    return n.edges.agg(F.count("*").alias("edges")).crossJoin(n.centroids.agg(F.count("*").alias("centroids"))).select("edges", "centroids", F.lit(n.shape[0]).alias("nz"))


@query("S13_json", sql("SELECT src, dst, weight FROM graph", "graph"))
def s13(spark, sf):
    path = shared_dir(spark, "graph") + ".json"
    T.write_json(E.collapse(I.edges(spark, sf)), path)
    return spark.read.schema("src long, dst long, weight long").json(path)


for _kind, _mark in (("graphml", "<edge source="), ("gexf", "<edge source="), ("pajek", None)):

    def _export(spark, sf, _kind=_kind, _mark=_mark):
        path = shared_dir(spark, _kind)
        near = B.pairs(I.centroids(spark, sf), I.NEAR).select(F.col("node_a").alias("src"), F.col("node_b").alias("dst"), F.lit(1).cast("long").alias("weight"))
        T.export_graph(near, path, _kind)
        lines = spark.read.text(path)
        pairs = lines.where(F.startswith("value", F.lit(_mark))) if _mark else lines.where(F.col("value").rlike(r"^\d+ \d+ \d+$"))
        return pairs.agg(F.count("*").alias("edges"))

    query(f"S14_{_kind}", sql("SELECT count(*) AS edges FROM near", "near"))(_export)


@query("S16_import_columns", "SELECT row_number() OVER (ORDER BY n_nationkey, n_regionkey) AS id, n_nationkey AS y, n_regionkey AS x, 1 AS z FROM nation")
def s16(spark, sf):
    return T.import_columns(table(spark, sf, "nation"), {"y": "n_nationkey", "x": "n_regionkey"})


@query("S18_configuration", "SELECT n_name AS name, r_name AS every, CASE WHEN n_nationkey % 2 = 0 THEN 'N' || n_nationkey ELSE '' END AS none FROM nation JOIN region ON r_regionkey = n_regionkey")
def s18(spark, sf):
    path = shared_dir(spark, "configuration")
    rules = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name").collect()  # a rule for each nation
    T.save_configuration([(r.n_name, [r.r_name], [f"N{r.n_nationkey}"] if r.n_nationkey % 2 == 0 else []) for r in rules], path, spark)
    return spark.createDataFrame([(n, ",".join(a), ",".join(x)) for n, a, x in T.load_configuration(path, spark)], "name string, every string, none string")


@query("X_stream_degrees", sql("SELECT id, CAST(count(*) AS BIGINT) AS degree FROM (SELECT node_a AS id FROM near UNION ALL SELECT node_b FROM near) GROUP BY 1", "near"))
def stream_degrees(spark, sf):
    path = shared_dir(spark, "edges")
    I.near(spark, sf).repartition(3).write.parquet(path)
    source = spark.readStream.schema("node_a long, node_b long, edge_c long").option("maxFilesPerTrigger", 1).parquet(path)
    out = shared_dir(spark, "degrees")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(out)

    q = S.running_degrees(source).writeStream.outputMode("complete").option("checkpointLocation", shared_dir(spark, "stream")).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query("X_stream_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, user_id AS node, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    return S.windowed_counts(table(spark, sf, "events"), "ts", "user_id", "1 day", "1 hour")


@query("C7_pixel_classifier")
def c7(spark, sf):
    image = I.channel(spark, sf)
    rows = settle(R.pixel_features(image, SHAPE), "features")
    marks = image.where("(y + x) % 3 = 0").select("z", "y", "x", (F.col("value") > 100).cast("int").alias("mark"))
    return R.classify_pixels(rows, marks)


@query("C8_threshold_predictor")
def c8(spark, sf):
    s = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_size") * 2.0 + 1).alias("t"))
    return R.predict_thresholds(s.where("p_partkey % 2 = 0"), ["a", "b"], ["t"], s.where("p_partkey % 2 = 1").select("p_partkey", "a", "b")).select("p_partkey", F.round("predicted_t", 6).alias("t"))


@query("M7_grey_watershed")
def m7(spark, sf):
    return R.grey_watershed(I.channel(spark, sf), 300.0)


@query("M24_trace")
def m24(spark, sf):
    return R.trace(skeleton(spark, sf), 3.0, 2, depth(spark, sf))


@query("M25_stitches")
def m25(spark, sf):
    return R.stitches(skeleton(spark, sf), 3.0, depth(spark, sf))


_ENDS = "few AS (SELECT * FROM vox), n AS (SELECT a.z, a.y, a.x, a.label, count(*) AS n FROM few a JOIN few b ON a.label = b.label AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE (a.z, a.y, a.x) <> (b.z, b.y, b.x) GROUP BY 1, 2, 3, 4), ends AS (SELECT z, y, x, label FROM n WHERE n = 1)"


@query("M26_end_points", sql(f"AND {_ENDS} SELECT * FROM ends", "vox"))
def m26e(spark, sf):
    return R.end_points(nodes(spark, sf))


@query("M26_joinable_ends", sql(f"AND {_ENDS} SELECT a.label AS label_a, b.label AS label_b, a.z AS az, a.y AS ay, a.x AS ax, b.z AS bz, b.y AS byy, b.x AS bx, round(sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2), 6) AS dist FROM ends a JOIN ends b ON a.label < b.label WHERE (a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 9", "vox"))
def m26(spark, sf):
    p = R.joinable_ends(nodes(spark, sf), 3.0)
    return p.select("label_a", "label_b", F.col("a.z").alias("az"), F.col("a.y").alias("ay"), F.col("a.x").alias("ax"), F.col("b.z").alias("bz"), F.col("b.y").alias("byy"), F.col("b.x").alias("bx"), F.round("dist", 6).alias("dist"))


_WALK = "nb AS MATERIALIZED (SELECT a.label, a.z AS z, a.y AS y, a.x AS x, {k} AS u, {v} AS v FROM vox a JOIN vox b ON a.label = b.label AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE (a.z, a.y, a.x) <> (b.z, b.y, b.x)), inn AS MATERIALIZED (SELECT u FROM nb GROUP BY 1 HAVING count(*) = 2), wk(c, f, p, v, i) AS (SELECT u, v, u, v, 1 FROM nb WHERE u NOT IN (FROM inn) AND v IN (FROM inn) UNION ALL SELECT c, f, wk.v, nb.v, i + 1 FROM wk JOIN nb ON nb.u = wk.v AND nb.v <> wk.p WHERE nb.v IN (FROM inn)), w AS (SELECT v, min(struct_pack(c := c, f := f, i := i)) AS a, max(struct_pack(c := c, f := f, i := i)) AS b FROM wk GROUP BY 1)".format(
    **{n: " + ".join(f"(CAST({t}.{c} AS BIGINT) + 1048576) * {m}" for c, m in (("z", 1 << 42), ("y", 1 << 21), ("x", 1))) for n, t in (("k", "a"), ("v", "b"))}
)


@query("M24_chain_ranks", sql(f"AND {_WALK} SELECT v, a.c AS end_a, a.f AS first_a, b.c AS end_b, b.f AS first_b, CAST(a.i AS BIGINT) AS rank, CAST(a.i + b.i AS BIGINT) AS length FROM w", "vox", recursive=True))
def m24r(spark, sf):
    return chains.ranked(nodes(spark, sf))


@query("M24_bodies")
def m24b(spark, sf):
    return chains.bodies(skeleton(spark, sf), depth(spark, sf), SHAPE, 3)


_OPEN = "open AS MATERIALIZED (SELECT DISTINCT v.z + dz AS z, v.y + dy AS y, v.x + dx AS x FROM vox v, (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) f(dz, dy, dx) WHERE (v.z + dz, v.y + dy, v.x + dx) NOT IN (SELECT (z, y, x) FROM vox)), er AS MATERIALIZED (SELECT e.z, e.y, e.x, e.label, sqrt(min((e.z - o.z) ** 2 + (e.y - o.y) ** 2 + (e.x - o.x) ** 2)) AS r FROM ends e, open o GROUP BY ALL)"


@query("M26_joined_ends", sql(f"""AND {_ENDS}, {_OPEN},
    j AS (SELECT a.label, a.z AS az, a.y AS ay, a.x AS ax, b.z AS bz, b.y AS by1, b.x AS bx, a.r AS ra, b.r AS rb, sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d FROM er a JOIN er b ON a.label < b.label WHERE (a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 9),
    many AS (SELECT *, CAST(greatest(3, floor(d * CASE WHEN abs(ra - rb) > 2 THEN 3 ELSE 2 END)) AS INT) AS n FROM j),
    steps AS (SELECT *, CASE WHEN i = n - 1 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / (n - 1)) END AS t FROM (SELECT *, unnest(range(n)) AS i FROM many)),
    m AS (SELECT trunc(az * (1 - t) + bz * t) AS z, trunc(ay * (1 - t) + by1 * t) AS y, trunc(ax * (1 - t) + bx * t) AS x, round_even((ra * (1 - t) + rb * t) * 2, 0) / 2 AS r, min(label) AS label FROM steps GROUP BY 1, 2, 3, 4),
    s AS (SELECT unnest(range(-8, 9)) AS s),
    g AS (SELECT m.z + a.s AS z, m.y + b.s AS y, m.x + c.s AS x, label FROM m, s a, s b, s c WHERE a.s * a.s + b.s * b.s + c.s * c.s <= r * r),
    drawn AS (SELECT CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x, min(label) AS label FROM g WHERE z BETWEEN 0 AND 23 AND y BETWEEN 0 AND 59 AND x BETWEEN 0 AND 59 GROUP BY 1, 2, 3)
    SELECT z, y, x, label FROM vox UNION ALL SELECT * FROM drawn ANTI JOIN vox USING (z, y, x)""", "vox"))
def m26j(spark, sf):
    image = nodes(spark, sf)
    deep = settle(squared_depths(image.withColumn("label", F.lit(1))).select(F.struct("z", "y", "x").alias("p"), F.sqrt("d2").alias("r")), "depths")
    ends = R.joinable_ends(image, 3.0)
    for side in "ab":
        ends = ends.join(deep.select(F.col("p").alias(side), F.col("r").alias(f"r{side}")), side)
    return chains.joined_ends(image, ends, SHAPE)
