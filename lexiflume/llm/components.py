"""Connected components by alternating large-star and small-star steps; links stay on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexiflume.llm.scratch import Scratch


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _tidy(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _tidy(edges.join(least, "u").select("v", "m").toDF("u", "v").union(least))


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """edges (u long, v long), any direction, repeats allowed. Returns (node, component): the least node it reaches.

    Nodes without a link to another node are not listed. Each round is written to the shared folder, so a lost
    executor costs one round at most. Rounds grow with the logarithm of the input.
    """
    now = scratch.keep(f"{tag}-0", _tidy(edges))
    last, step = None, 0
    while True:
        # Equal sums of hashed edges before and after a round: nothing moved.
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first())
        if mark == last:
            break
        last, step = mark, step + 1
        then = scratch.keep(f"{tag}-{step}", _small_star(_large_star(now)))
        scratch.drop(f"{tag}-{step - 1}")
        now = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
