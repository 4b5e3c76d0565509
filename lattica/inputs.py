"""The driver's tables as parts of a spatial network, for the registered queries; and the same parts in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .helpers import grid_join


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def occurrences(spark, sf):
    """(edge, node): suppliers that an order touches; keys are shifted by one, since label 0 is the background."""
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") + 1).alias("edge"), (F.col("l_suppkey") + 1).alias("node"))


def edges(spark, sf):
    """Suppliers that share an order."""
    from .operators.edges import co_occurrence

    return co_occurrence(occurrences(spark, sf))


def identities(spark, sf):
    """Suppliers with their region, and `credit` for a balance over 5000; those in debt have none."""
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    ids = F.when(F.col("s_acctbal") > 5000, F.array("r_name", F.lit("credit"))).otherwise(F.array("r_name"))
    return rows.where("s_acctbal >= 0").select((F.col("s_suppkey") + 1).alias("id"), ids.alias("ids"))


def communities(spark, sf):
    return table(spark, sf, "supplier").select((F.col("s_suppkey") + 1).alias("id"), F.col("s_nationkey").cast("long").alias("com"))


def centroids(spark, sf):
    """Three coordinates of each embedding in thousandths."""
    at = lambda i: F.rint(1000 * F.col("embedding")[i].cast("double")).cast("int")
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), at(0).alias("z"), at(1).alias("y"), at(2).alias("x"))


def point_identities(spark, sf):
    e = table(spark, sf, "embeddings")
    label = F.concat(F.lit("L"), (F.col("label") % 3).cast("string"))
    return e.select(F.col("vec_id").cast("long").alias("id"), F.when(F.col("vec_id") % 5 == 0, F.array(label, F.lit("even"))).otherwise(F.array(label)).alias("ids"))


def point_communities(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("com"))


#: Radius of the sparse graph.
NEAR = 50.0


def near(spark, sf, radius: float = NEAR):
    """The sparse graph: centroids at a distance of at most 50, each pair once."""
    c = centroids(spark, sf)
    return grid_join(c, c, radius).where("l.id < r.id").select(F.col("l.id").alias("node_a"), F.col("r.id").alias("node_b"), F.lit(0).cast("long").alias("edge_c"))


def voxels(spark, sf):
    """Events as voxels of 24 x 60 x 60: hour, user and value; the label is the least event of the cell modulo 40."""
    e = table(spark, sf, "events")
    cell = [F.hour("ts").alias("z"), (F.col("user_id") % 60).cast("int").alias("y"), F.floor(F.col("value") % 60).cast("int").alias("x")]
    return e.where("value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL").groupBy(*cell).agg((F.min("event_id") % 40 + 1).alias("label"))


def channel(spark, sf):
    """The voxels' intensities: sum of values, zero where it is below 30."""
    e = table(spark, sf, "events")
    cell = [F.hour("ts").alias("z"), (F.col("user_id") % 60).cast("int").alias("y"), F.floor(F.col("value") % 60).cast("int").alias("x")]
    value = F.round(F.sum("value"), 2)
    return e.where("value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL").groupBy(*cell).agg(F.when(value < 30, 0.0).otherwise(value).alias("value"))


_CELL = "hour(ts)::INT AS z, (user_id % 60)::INT AS y, floor(value % 60)::INT AS x"
_EVENTS = "FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2, 3"
_AT = "CAST(round_even(1000 * CAST(embedding[{}] AS DOUBLE), 0) AS INT)"
PARTS = {
    "occ": "SELECT DISTINCT l_orderkey + 1 AS edge, l_suppkey + 1 AS node FROM lineitem",
    "edges": "SELECT a.node AS node_a, b.node AS node_b, a.edge AS edge_c FROM occ a JOIN occ b ON a.edge = b.edge AND a.node < b.node",
    "graph": "SELECT least(node_a, node_b) AS src, greatest(node_a, node_b) AS dst, count(*) AS weight FROM edges GROUP BY 1, 2",
    "idents": "SELECT s_suppkey + 1 AS id, CASE WHEN s_acctbal > 5000 THEN [r_name, 'credit'] ELSE [r_name] END AS ids FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal >= 0",
    "coms": "SELECT s_suppkey + 1 AS id, CAST(s_nationkey AS BIGINT) AS com FROM supplier",
    "cent": f"SELECT CAST(vec_id AS BIGINT) AS id, {_AT.format(1)} AS z, {_AT.format(2)} AS y, {_AT.format(3)} AS x FROM embeddings",
    "pids": "SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 5 = 0 THEN ['L' || (label % 3), 'even'] ELSE ['L' || (label % 3)] END AS ids FROM embeddings",
    "pcoms": "SELECT CAST(vec_id AS BIGINT) AS id, CAST(label AS BIGINT) AS com FROM embeddings",
    "pairs": "SELECT a.id AS i, b.id AS j, CAST((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS DOUBLE) AS d2 FROM cent a JOIN cent b ON a.id <> b.id",
    "near": "SELECT i AS node_a, j AS node_b, 0 AS edge_c FROM pairs WHERE i < j AND d2 <= 2500",
    "sym": "SELECT node_a AS a, node_b AS b FROM near UNION SELECT node_b, node_a FROM near",
    "verts": "SELECT DISTINCT a AS id FROM sym",
    "vox": f"SELECT {_CELL}, min(event_id) % 40 + 1 AS label {_EVENTS}",
    "chan": f"SELECT {_CELL}, CASE WHEN round(sum(value), 2) < 30 THEN 0.0 ELSE round(sum(value), 2) END AS value {_EVENTS}",
}
_NEEDS = {"edges": ["occ"], "graph": ["occ", "edges"], "pairs": ["cent"], "near": ["cent", "pairs"], "sym": ["cent", "pairs", "near"], "verts": ["cent", "pairs", "near", "sym"]}


def sql(body: str, *parts: str, recursive: bool = False) -> str:
    """body behind a WITH of the parts it names and what they need; more definitions may open the body with `AND name AS (...)`."""
    order: list[str] = []
    for p in parts:
        for q in [*_NEEDS.get(p, []), p]:
            if q not in order:
                order.append(q)
    defined = ", ".join(f"{p} AS ({PARTS[p]})" for p in order)
    body = body.strip()
    more = ""
    if body.startswith("AND "):
        more, body = "", body[4:]
        return f"WITH {'RECURSIVE ' * recursive}{defined}, {body}"
    return (f"WITH {'RECURSIVE ' * recursive}{defined} " if defined else "") + more + body
