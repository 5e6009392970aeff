"""Intermediate tables that every executor and the driver can read.

They go below ``spark.checkpoint.dir``. Only a local session without that setting (tests, a laptop) gets a folder of its own;
elsewhere the cluster must name its shared folder. A run's folder goes with ``close``, or when the driver ends.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Spark deletes a job's shuffle files when its SQL execution ends; a kept table is never made again from them.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get(KEY, None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{KEY} must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lexiflume-")
        spark.conf.set(KEY, where)
    return where.rstrip("/")


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores as no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables of one operator run: ``keep`` writes one and reads it back, ``drop`` deletes it, ``close`` deletes all.

    Results of operators read from here, so whoever hands over a Scratch closes it after the result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths, self.marked = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", {}, False

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _path(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        where = f"{self.root}/{name}"
        if not self.marked:
            path, system = self._path(self.root)
            system.mkdirs(path)
            self.marked = system.deleteOnExit(path)
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(where)
        finally:
            self.spark.conf.unset(_CLEAN) if before is None else self.spark.conf.set(_CLEAN, before)
        self.paths[name] = where
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        for name in names:
            path, system = self._path(self.paths.pop(name))
            system.delete(path, True)

    def close(self) -> None:
        path, system = self._path(self.root)
        system.delete(path, True)
        self.paths.clear()
