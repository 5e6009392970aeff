"""The property graph as tables: four Parquet inputs, upserts of vertices and edges, import in order."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiflume.operators import graph
from lexiflume.sources.parts import PartTable
from lexiflume.sources.store import assert_unique, exists

#: Input tables and what they are keyed by, in the order of import.
INPUTS = {"text_units": "id", "entities": "title", "relationships": "id", "community_reports": "id"}
TABLES = ("TextUnit", "Entity", "MENTIONS", "RELATED_TO", "CommunityReport")


def read_inputs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The input tables that are there."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in INPUTS if exists(spark, f"{folder}/{name}.parquet")}


class GraphStore:
    """Vertex and edge tables by key; an import replaces rows of equal key and adds the others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame | None:
        return PartTable(self.spark, f"{self.path}/{name}").read()

    def _put(self, name: str, rows: DataFrame, key: str) -> None:
        PartTable(self.spark, f"{self.path}/{name}").upsert(rows.withColumn("_at", F.lit(time.time_ns())), key, "_at")

    def text_units(self, rows: DataFrame) -> None:
        self._put("TextUnit", rows.withColumn("id", F.col("id").cast("string")), "id")

    def entities(self, rows: DataFrame) -> None:
        """Entities by trimmed title, and MENTIONS from the text units that exist."""
        named = rows.withColumn("name", F.trim("title"))
        self._put("Entity", named.drop("text_unit_ids"), "name")
        units = self.table("TextUnit")
        if units is not None:
            edges = graph.mentions(named.select("name", F.col("text_unit_ids").cast("array<string>").alias("unit_ids")), units.select(F.col("id").alias("unit_id")))
            self._put("MENTIONS", edges.withColumn("key", F.concat_ws("\u0001", "unit_id", "name")), "key")

    def relationships(self, rows: DataFrame) -> None:
        """RELATED_TO edges by id; endpoints without an entity get a bare one."""
        edges = rows.withColumns({"id": F.col("id").cast("string"), "source": F.trim("source"), "target": F.trim("target")})
        self._put("RELATED_TO", edges, "id")
        known = self.table("Entity")
        ends = edges.select(F.explode(F.array("source", "target")).alias("name")).distinct()
        self._put("Entity", ends if known is None else ends.join(known.select("name"), "name", "left_anti"), "name")

    def community_reports(self, rows: DataFrame) -> None:
        self._put("CommunityReport", rows.withColumn("id", F.col("id").cast("string")), "id")

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def import_all(self, folder: str, clear_first: bool = False) -> list[str]:
        """Checks that keys are unique, then imports units, entities, relationships and reports, in this order (S12); returns
        what was imported. Missing inputs are passed over."""
        if clear_first:
            self.clear()
        done = []
        for name, rows in read_inputs(self.spark, folder).items():
            if assert_unique(rows, INPUTS[name]).limit(1).count():
                raise ValueError(f"{name}: {INPUTS[name]} is not unique")
            getattr(self, name)(rows)
            done.append(name)
        return done

    def counts(self) -> DataFrame:
        """name, n of each table."""
        out = self.spark.createDataFrame([], "name string, n long")
        for name in TABLES:
            rows = self.table(name)
            if rows is not None:
                out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"))
        return out
