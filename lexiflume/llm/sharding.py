"""Sharding by longest-processing-time scheduling: documents with equal texts stay together.

Groups, largest first, go to the least-loaded shard through a heap. Groups of one size are alike, so the driver schedules the
table of sizes and their numbers: whole levels of a size at once, the rest one by one through the heap. Sizes above
2 ** DIGITS count with DIGITS binary digits (so that sizes a two-thousandth apart are told apart), so that table is bounded, whatever the input.
Spark then numbers the groups of each size, and a number gives the shard. A group that holds more than a
shard's share keeps a shard to itself.

Null texts count as empty; rows with a null doc_id and repeated rows are placed as any other; texts may have any length; an empty table
gives no rows; columns other than id and text are ignored, whatever their names. Ties go by shard, and by the texts' md5.
"""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from lexiflume.llm.numbering import numbered, run_of, spread
from lexiflume.llm.scratch import Scratch, unused

#: Binary digits of a size that are told apart: at most 2 ** DIGITS * 52 / 2 sizes, some ten thousand in practice.
DIGITS = 12
#: A group with more than one in so many rows is placed by a broadcast: there are at most so many.
HEAVY = 1000


def deal(loads: list[int], size: int, n: int) -> Counter:
    """How many of n items of one size each shard gets when each goes to the least-loaded (of equal ones the first); adds to loads."""
    got: Counter = Counter()
    if n > 2 * len(loads):
        # All places below a level are taken before any above it: the highest level that n items fill.
        below = lambda level: [max(0, -(-(level - x) // size)) for x in loads]
        low, high = min(loads), min(loads) + size * n
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sum(below(middle)) <= n else (low, middle - 1)
        got.update(dict(enumerate(below(low))))
    heap = [(x + size * got[s], s) for s, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(n - sum(got.values())):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
        got[s] += 1
    for s, m in got.items():
        loads[s] += m * size
    return got


def _rounded(size: str) -> Column:
    digits = f"greatest(0, length(bin({size})) - {DIGITS})"
    return F.expr(f"shiftleft(shiftright({size}, {digits}), {digits})")


def lpt_shards(documents: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Returns doc_id, size, text_crc32, law, shard, slot, grown_shard and grp (md5 of the text) for each row."""
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("grp"), spread().alias("spread"))
    rows = scratch.keep("rows", rows)
    groups = scratch.keep("groups", rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).withColumn("rounded", _rounded("bytes")))
    sizes = groups.groupBy("rounded").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).orderBy(F.desc("rounded")).collect()  # bounded by DIGITS
    n_groups, n_rows = sum(x.n for x in sizes), rows.count()
    loads, dealt = [0] * n_shards, []
    for x in sizes:
        got = sorted(deal(loads, x.bytes // x.n, x.n).items())
        ends, shards = [], []
        for shard, m in got:
            if m:
                ends.append((ends[-1] if ends else 0) + m)
                shards.append(shard)
        dealt.append((x.rounded, ends, shards))
    places = spark.createDataFrame(dealt, "rounded long, ends array<long>, shards array<int>")
    ranked = numbered(groups.withColumn("run", run_of(n_groups, "grp")), "rounded", ["grp"]).join(F.broadcast(places), "rounded")
    at = scratch.keep("at", ranked.select("grp", "n", F.expr("element_at(shards, size(filter(ends, e -> e <= number)) + 1)").alias("shard")))
    heavy = F.col("n") * HEAVY > n_rows
    few, many = at.where(heavy).select("grp", "shard"), at.where(~heavy).select("grp", "shard")
    placed = rows.join(F.broadcast(few), "grp").unionByName(rows.join(F.broadcast(few), "grp", "left_anti").join(many, "grp"))
    placed = scratch.keep("placed", placed.withColumn("run", run_of(n_rows // n_shards, "doc_id", "text_crc32", "spread")))
    scratch.drop("rows", "groups", "at")
    out = numbered(placed, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("number").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "grp")


def write_shards(documents: DataFrame, path: str, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all columns of the documents as Parquet, a folder shard=N for each shard."""
    with Scratch(documents.sparkSession) as scratch:
        key = unused("grp", documents.columns)
        found = lpt_shards(documents, n_shards, id_col, text_col, scratch).groupBy("grp").agg(F.first("shard").alias("shard")).withColumnRenamed("grp", key)
        keyed = documents.withColumn(key, F.md5(F.coalesce(F.col(text_col), F.lit("")))).join(found, key).drop(key)
        keyed.write.partitionBy("shard").parquet(path)
