"""A table of rows by key that batches are merged into: Spark's dynamic partition overwrite replaces the touched parts only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexiflume.sources.store import cleaning, dropped, kept

#: Rows of the first batch for each part, and the most parts a table gets.
ROWS, MOST = 50_000, 4096
_PART = "_part"


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the greatest order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


class PartTable:
    """Rows lie in parts by the hash of their key, as many as the first batch asks for (or n_parts); the folder's name tells. A batch that is merged again after a
    failure leaves the same rows, as the greatest order counts."""

    def __init__(self, spark: SparkSession, path: str, n_parts: int | None = None):
        self.spark, self.path, self.n_parts = spark, path.rstrip("/"), n_parts

    def _found(self) -> tuple[str, int] | None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []
        sizes = [int(n.removeprefix("parts-")) for n in names if n.startswith("parts-")]
        return (f"{self.path}/parts-{sizes[0]}", sizes[0]) if sizes else None

    def read(self) -> DataFrame | None:
        """All rows; None if there is no table yet."""
        found = self._found()
        return found and self.spark.read.option("mergeSchema", True).parquet(found[0]).drop(_PART)

    def upsert(self, batch: DataFrame, key: str, order: str) -> None:
        """The row with the greatest order counts for each key. New columns are null in earlier rows."""
        found = self._found()
        if not found:
            rows = kept(latest(batch, key, order))
            n = self.n_parts or max(8, min(MOST, -(-rows.count() // ROWS)))
            found = f"{self.path}/parts-{n}", n
        else:
            part = F.pmod(F.xxhash64(key), F.lit(found[1])).cast("int")
            touched = [r.p for r in batch.select(part.alias("p")).distinct().collect()]  # MOST at most
            if not touched:
                return
            old = self.spark.read.option("mergeSchema", True).parquet(found[0]).where(F.col(_PART).isin(touched)).drop(_PART)
            rows = old.unionByName(batch, allowMissingColumns=True)
            rows = kept(latest(rows, key, order))  # the parts are read before they are replaced
        merged = rows.withColumn(_PART, F.pmod(F.xxhash64(key), F.lit(found[1])).cast("int"))
        with cleaning(self.spark):
            merged.repartition(_PART).sortWithinPartitions(_PART, key).write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(found[0])
        dropped(rows)
