"""Gapless numbers within keys, without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows that are numbered together, about.
RUN = 2000


def spread() -> Column:
    """A number that tells equal rows apart, by their places in the table that is read."""
    return F.monotonically_increasing_id() % 1024


def run_of(n_rows: int, *of: str) -> Column:
    """The run of a row, by its hash."""
    return F.pmod(F.xxhash64(*of), F.lit(max(1, n_rows // RUN)))


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows (a kept table with a column run) with number: gapless from 0 within each key, run after run."""
    before = Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(key, "run").agg(F.count("*").alias("run_rows")).select(key, "run", F.coalesce(F.sum("run_rows").over(before), F.lit(0)).alias("run_first"))
    within = Window.partitionBy(key, "run").orderBy(*order)
    placed = rows.withColumn("run_place", F.row_number().over(within) - 1).join(starts, [key, "run"])
    return placed.withColumn("number", (F.col("run_first") + F.col("run_place")).cast("long")).drop("run", "run_place", "run_first")
