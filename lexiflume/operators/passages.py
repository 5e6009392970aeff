"""Which documents contain which passages: relevance sets from a corpus and its planted queries."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexiflume.sources.store import kept, scratch_path

#: Characters of passages that are searched for at once (some hundred bytes of memory each).
BLOCK = 1_000_000


def containing(queries: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """query_id, doc_id, rel 1 where the document's text holds the query's text as it is.

    Passages go in blocks; a task makes one automaton of a block's passages and goes through each of its documents once, whatever the number of passages. Nothing of
    the documents is shuffled. Several blocks are searched one after another. A null text holds nothing and is in nothing; an empty passage is in every text."""
    spark = docs.sparkSession
    schema = "query_id long, doc_id long"
    passages = kept(queries.where("text is not null").select(F.col("query_id").cast("long").alias("query_id"), "text"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_blocks = max(1, -(-(passages.agg(F.sum(F.length("text"))).first()[0] or 0) // block))
    dealt = passages.withColumn("block", F.pmod(F.xxhash64("query_id", "text"), F.lit(n_blocks)))
    path = scratch_path(spark, "held")

    def plan(i: int) -> DataFrame:
        by_text: dict[str, list[int]] = {}
        for r in dealt.where(F.col("block") == i).collect():  # about BLOCK characters
            by_text.setdefault(r.text, []).append(r.query_id)
        sent = spark.sparkContext.broadcast((by_text.pop("", []), list(by_text.items())))

        def search(batches):
            everywhere, some = sent.value
            machine = ahocorasick.Automaton()
            for n, (text, _) in enumerate(some):
                machine.add_word(text, n)
            if some:
                machine.make_automaton()
            for b in batches:
                asked, found = [], []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    hits = {n for _, n in machine.iter(text)} if some else ()
                    ids = everywhere + [q for n in hits for q in some[n][1]]
                    asked += ids
                    found += [doc] * len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(found, pa.int64())], ["query_id", "doc_id"])

        return texts.mapInArrow(search, schema)

    if n_blocks == 1:
        return plan(0).distinct().withColumn("rel", F.lit(1))
    for i in range(n_blocks):
        plan(i).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).distinct().withColumn("rel", F.lit(1))
