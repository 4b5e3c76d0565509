"""Tables in files: networks, centroids, identities, scalings; reading and writing them under the documented headers."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..helpers import settle
from ..model import Scale
from ..operators.identity import parse


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all cells as text, or JSON lines."""
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.option("header", True).option("escape", '"').csv(path)


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """Edges from columns in groups of three (two where the objects are missing); further groups are more rows. Cells that are no numbers
    drop their row; a missing object is 0."""
    raw = _read(spark, path)
    names = [f"c{i}" for i in range(len(raw.columns))]
    raw = raw.toDF(*names)
    groups = [names[i : i + 3] for i in range(0, len(names), 3)] if len(names) != 2 else [names]
    cell = lambda c: F.col(c).try_cast("double").cast("long")
    rows = [F.struct(cell(g[0]).alias("node_a"), cell(g[1]).alias("node_b"), (F.coalesce(cell(g[2]), F.lit(0)) if len(g) > 2 else F.lit(0)).cast("long").alias("edge_c")) for g in groups if len(g) > 1]
    return raw.select(F.explode(F.array(*rows)).alias("e")).select("e.*").where("node_a IS NOT NULL AND node_b IS NOT NULL")


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    raw = _read(spark, path)
    names = raw.columns if not path.rstrip("/").endswith((".json", ".jsonl")) else [c for w in ("Node ID", "Z", "Y", "X") for c in raw.columns if c == w]
    return raw.select(*[F.col(f"`{c}`").try_cast("double").cast(t).alias(n) for c, n, t in zip(names, ("id", "z", "y", "x"), ("long", "int", "int", "int"))]).where("id IS NOT NULL")


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """(id, value) with the value as text."""
    raw = _read(spark, path)
    return raw.select(F.col(f"`{raw.columns[0]}`").try_cast("double").cast("long").alias("id"), F.col(f"`{raw.columns[1]}`").cast("string").alias("value")).where("id IS NOT NULL")


def read_identities(spark: SparkSession, path: str) -> DataFrame:
    return read_values(spark, path).select("id", parse("value").alias("ids"))


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    return read_values(spark, path).select("id", F.col("value").try_cast("double").cast("long").alias("com"))


def read_scale(spark: SparkSession, path: str) -> Scale:
    """From lines `xy_scale: number` and `z_scale: number`; what is missing is 1."""
    at = lambda n: F.max(F.regexp_extract("value", rf"^\s*{n}\s*:\s*([0-9.eE+-]+)", 1).try_cast("double")).alias(n)
    r = spark.read.text(path).agg(at("xy_scale"), at("z_scale")).first()
    return Scale(r.xy_scale or 1.0, r.z_scale or 1.0)


def write_csv(df: DataFrame, path: str, headers: list[str]) -> None:
    """A folder of CSV files under the given headers; arrays become JSON."""
    cells = [F.to_json(F.col(c)) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*[c.alias(h) for c, h in zip(cells, headers)]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_network(edges: DataFrame, path: str) -> None:
    write_csv(edges.select("node_a", "node_b", "edge_c"), path, ["Node A", "Node B", "Edge C"])


def write_centroids(centroids: DataFrame, path: str) -> None:
    write_csv(centroids.select("id", "z", "y", "x"), path, ["Node ID", "Z", "Y", "X"])


def write_identities(identities: DataFrame, path: str) -> None:
    write_csv(identities.select("id", "ids"), path, ["NodeID", "Identity"])


def write_communities(communities: DataFrame, path: str) -> None:
    write_csv(communities.select("id", "com"), path, ["NodeID", "Community"])


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def import_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns of a spreadsheet as a property: mapping names the column for each of the property's fields. Without a column for `id` rows are
    numbered from 1 in the order of their cells; a missing z is 1."""
    from ..operators.ranks import numbered

    cells = {k: F.col(f"`{v}`") for k, v in mapping.items()}
    rows = df.select(*[c.alias(k) for k, c in cells.items()])
    if "id" not in mapping:
        rows = numbered(rows, *mapping, start=1, name="id")
    if {"y", "x"} <= set(mapping):
        rows = rows.withColumn("z", F.coalesce("z", F.lit(1)) if "z" in mapping else F.lit(1))
    return rows


def save_configuration(rules: list[tuple[str, list[str], list[str]]], path: str, spark: SparkSession) -> None:
    """Classifier rules as one JSON text."""
    spark.createDataFrame([(json.dumps([{"name": n, "all": a, "none": x} for n, a, x in rules]),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_configuration(path: str, spark: SparkSession) -> list[tuple[str, list[str], list[str]]]:
    return [(r["name"], r["all"], r["none"]) for r in json.loads(spark.read.text(path, wholetext=True).first().value)]


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")


def export_graph(graph: DataFrame, path: str, kind: str) -> None:
    """GEXF, GraphML or Pajek text, packed by gzip. Lines are made in Spark; the folder's files, in the order of their names, are the document. Edges
    are written where they are found, in no order, so that only nodes are shuffled."""
    head = {
        "graphml": ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="w" for="edge" attr.name="weight" attr.type="long"/><graph edgedefault="undirected">'],
        "gexf": ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected">'],
        "pajek": [],
    }[kind]
    from ..operators.graph import vertices
    from ..operators.ranks import numbered

    spark = graph.sparkSession
    v, e = settle(numbered(vertices(graph), "id", start=1, name="i"), "vertices"), graph
    if kind == "pajek":
        a, b = v.select(F.col("id").alias("src"), F.col("i").alias("si")), v.select(F.col("id").alias("dst"), F.col("i").alias("di"))
        e = graph.join(a, "src").join(b, "dst")
    make = {
        "graphml": ('<node id="%d"/>', '<edge source="%d" target="%d"><data key="w">%d</data></edge>', ["</graph></graphml>"]),
        "gexf": ('<node id="%d"/>', '<edge source="%d" target="%d" weight="%d"/>', ["</graph></gexf>"]),
        "pajek": ('%d "%d"', "%d %d %d", []),
    }[kind]
    before, between, behind = {"gexf": (["<nodes>"], ["</nodes>", "<edges>"], ["</edges>"]), "pajek": ([f"*Vertices {v.count()}"], ["*Edges"], []), "graphml": ([], [], [])}[kind]
    fixed = lambda lines: spark.createDataFrame([(t,) for t in lines], "value string").coalesce(1)
    ordered = v.repartitionByRange("i").sortWithinPartitions("i")
    nodes = ordered.select((F.format_string(make[0], "i", "id") if kind == "pajek" else F.format_string(make[0], "id")).alias("value"))
    edges = e.select(F.format_string(make[1], *(("si", "di") if kind == "pajek" else ("src", "dst")), "weight").alias("value"))
    # partitions of a union follow one another, and files are named by their partition
    parts = [fixed(head + before), nodes, fixed(between), edges, fixed(behind + make[2])]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.union(part)
    lines.write.mode("overwrite").option("compression", "gzip").text(path)


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """(file, z, y, x, channel, value) of JPEG and PNG pictures, channels in the order red, green, blue; zeros have no row."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("int")))
    rows = raw.select("origin", "width", "nChannels", at.alias("i", "value")).where("value <> 0")
    pixel = F.floor(F.col("i") / F.col("nChannels")).cast("int")
    channel = F.when(F.col("nChannels") >= 3, F.lit(2) - F.col("i") % F.col("nChannels")).otherwise(F.lit(0))
    return rows.select(F.col("origin").alias("file"), F.lit(0).alias("z"), F.floor(pixel / F.col("width")).cast("int").alias("y"), (pixel % F.col("width")).alias("x"), channel.alias("channel"), F.col("value").cast("double").alias("value")).where("channel >= 0")


def png(page: np.ndarray) -> bytes:
    """A grey picture of 8 bits."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.zeros((page.shape[0], page.shape[1] + 1), np.uint8)  # each row begins with its filter, which is none
    rows[:, 1:] = page
    head = struct.pack(">IIBBBBB", page.shape[1], page.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def write_pictures(image: DataFrame, folder: str, shape: tuple[int, int, int], column: str = "value") -> DataFrame:
    """A PNG for each layer, values cut to whole numbers from 0 to 255; returns (z, path). Layers without rows have no file."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        z = int(pdf["z"].iloc[0])
        page = np.zeros(shape[1:], np.uint8)
        page[pdf["y"], pdf["x"]] = np.clip(pdf[column], 0, 255).astype(np.uint8)
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/layer-{z:06d}.png") as f:
            f.write(png(page))
        return pd.DataFrame({"z": [z], "path": [f"{folder}/layer-{z:06d}.png"]})

    return image.groupBy("z").applyInPandas(one, "z int, path string")
