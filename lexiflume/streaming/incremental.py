"""Incremental evaluation: the last row of each key of a stream, held in Spark's state store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiflume.sources.parts import latest
from lexiflume.sources.store import exists

__all__ = ["current", "latest", "run_upserts"]

#: State lies in RocksDB; a batch adds its changes to the checkpoint, not the whole state.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def run_upserts(spark: SparkSession, source: DataFrame, path: str, key: str, order: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Drains the streaming ``source``: for each key the row with the greatest order stays, in a streaming aggregation whose state and progress lie in the checkpoint
    below ``path``. A run goes on where the one before ended, or failed: a batch is counted once. on_batch gets the rows that a batch changed (at least
    once; the same rows with the same number after a failure). The number of parts of the state is that of spark.sql.shuffle.partitions at the first run."""
    last = source.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("row"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        changed = last.select("row.*").writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        changed = changed.foreachBatch(on_batch) if on_batch else changed.format("noop")
        changed.start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each key, read from the state store."""
    if not exists(spark, f"{path}/checkpoint/state"):
        raise FileNotFoundError(path)
    state = spark.read.format("statestore").load(f"{path}/checkpoint")
    held = state.schema["value"].dataType.fieldNames()[0]  # the row, then its order
    return state.select(F.col("value")[held].alias("row")).select("row.*")
