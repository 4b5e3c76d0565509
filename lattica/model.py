"""The data model: tables of a spatial network, kept together and never changed in place."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

#: Schemas of the tables. Labels are positive; a voxel without an object has no row. An edge_c of 0 names no connecting object.
VOXELS = "z int, y int, x int, label long"
EDGES = "node_a long, node_b long, edge_c long"
GRAPH = "src long, dst long, weight long"
CENTROIDS = "id long, z int, y int, x int"
IDENTITIES = "id long, ids array<string>"
COMMUNITIES = "id long, com long"


@dataclass(frozen=True)
class Scale:
    """Length of a voxel's side: x and y share one."""

    xy: float = 1.0
    z: float = 1.0

    @property
    def least(self) -> float:
        return min(self.xy, self.z)


@dataclass(frozen=True)
class SpatialNetwork:
    """A network with what is known of its nodes; operators take tables and give tables, and `put` makes a new network of them."""

    edges: DataFrame | None = None
    nodes: DataFrame | None = None
    centroids: DataFrame | None = None
    identities: DataFrame | None = None
    communities: DataFrame | None = None
    scale: Scale = Scale()
    shape: tuple[int, int, int] | None = None

    def put(self, **changes) -> SpatialNetwork:
        """A network with some tables replaced. Communities belong to the edges they were found in and go when those change."""
        if "edges" in changes and "communities" not in changes:
            changes["communities"] = None
        return replace(self, **changes)

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k in ("edges", "nodes", "centroids", "identities", "communities") if (v := getattr(self, k)) is not None}

    def save(self, folder: str) -> None:
        for name, table in self.tables().items():
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
        spark = next(iter(self.tables().values())).sparkSession
        spark.createDataFrame([(self.scale.xy, self.scale.z, *(self.shape or (None,) * 3))], "xy double, z double, nz int, ny int, nx int").write.mode("overwrite").parquet(f"{folder}/scale")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> SpatialNetwork:
        """The tables found under their fixed names; those that were not saved are missing."""
        from pyspark.errors import AnalysisException

        found = {}
        for name in ("edges", "nodes", "centroids", "identities", "communities"):
            try:
                found[name] = spark.read.parquet(f"{folder}/{name}")
            except AnalysisException:
                continue
        row = spark.read.parquet(f"{folder}/scale").first()
        return SpatialNetwork(**found, scale=Scale(row.xy, row.z), shape=(row.nz, row.ny, row.nx) if row.nz is not None else None)
