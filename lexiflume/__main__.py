"""python -m lexiflume ingest|retrieve|evaluate TABLES [INDEX]: builds an index, answers queries, prints a summary."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexiflume.operators.bm25 import Bm25Index
from lexiflume.plans.evaluation import EvalJob, formatted
from lexiflume.plans.retrieval import Retriever
from lexiflume.sources.store import exists
from lexiflume.sources.tables import chunks, questions, table


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("command", choices=["ingest", "retrieve", "evaluate"])
    args.add_argument("tables")
    args.add_argument("index", nargs="?")
    a = args.parse_args()
    spark = SparkSession.builder.getOrCreate()
    if a.index and exists(spark, a.index) and a.command != "ingest":
        index = Bm25Index.load(spark, a.index)
    else:
        index = Bm25Index.build(table(spark, a.tables, "documents"))
        if a.index:
            index.save(a.index)
    retriever = Retriever(index, chunks(spark, a.tables), table(spark, a.tables, "embeddings"))
    if a.command == "retrieve":
        retriever.retrieve(questions(spark, a.tables)).select("query_id", "selected", "expanded").show(truncate=False)
    elif a.command == "evaluate":
        job = EvalJob(retriever)
        for part in job.summary(job.run(questions(spark, a.tables))):
            print(formatted(part))


if __name__ == "__main__":
    main()
